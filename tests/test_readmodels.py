"""Listings, debates, rounds, dialects and profiles on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from papyrine.functions import text as tx
from papyrine.operators import evidence, profile, readmodels as rm, search as se, vocabulary as voc
from tests.test_operators import one


def test_debate_state_and_decisions(spark):
    ideas = spark.createDataFrame([(1, "as written", "t"), (2, " ", "title only"), (3, None, None)], "idea long, statement string, title string")
    rounds = [(1, 1, "first", 0.1, 0.5, False, None), (1, 2, " ", 0.2, None, True, "enough"), (2, 1, None, None, None, None, None)]
    rounds = spark.createDataFrame(rounds, "idea long, round int, revised string, drift double, distance double, terminated boolean, reason string")
    objections = [(1, 1, "major", "strong", "unresolved"), (1, 2, "minor", "weak", "unresolved"), (1, 2, "minor", "strong", None), (1, 1, "major", "strong", "resolved_by_evidence")]
    objections = spark.createDataFrame(objections, "idea long, round int, severity string, support string, status string")
    got = {r.idea: r for r in rm.debate_state(ideas, rounds, objections).collect()}
    a = got[1]
    assert (a.original, a.current, a.rounds_done, a.next_round, a.terminated, a.reason, a.drift, a.n_objections, a.n_standing, a.n_open) == ("as written", "first", 2, 3, True, "enough", 0.2, 4, 1, 2)
    assert [(x.round, x.distance, x.drift) for x in a.trajectory] == [(1, 0.5, 0.1), (2, None, 0.2)]
    assert (got[2].current, got[2].rounds_done, got[2].terminated, got[2].drift) == ("title only", 1, False, 0.0) and (got[3].original, got[3].rounds_done) == ("", 0)
    state = [(0.6, 20, 0, 0, "x"), (0.5, 20, 0, 0, None), (0.1, 3, 2, 0, "x"), (0.1, 10, 1, 1, "x"), (0.1, 3, 1, 1, " said "), (0.1, 3, 1, 1, " "), (None, 3, 1, 1, None)]
    state = spark.createDataFrame(state, "drift double, round int, n_open int, n_standing int, said string")
    assert [(r.why, r.terminated) for r in rm.decided(state).collect()] == [("drift", True), ("nothing cited is open", True), ("nothing cited is open, uncited remain", True), ("round cap", True), ("said", True), (None, False), (None, False)]


def test_rounds_that_count(spark):
    rounds = [(1, 1, "A", " "), (1, 2, "a ", "q"), (1, 3, "A", "q"), (1, 4, None, "q"), (1, 5, "", "q"), (2, 1, "a", "q")]
    got = {(r.check, r.round): r.error for r in rm.vetted_rounds(spark.createDataFrame(rounds, "check long, round int, angle string, query string")).collect()}
    assert got == {(1, 1): "empty query", (1, 2): None, (1, 3): "angle repeats an earlier round", (1, 4): None, (1, 5): None, (2, 1): None}


def test_refused_checks(spark):
    checks = [(1, "done", 1, "x"), (2, "scooped", 0, "x"), (3, "no_prior_art", 0, " "), (4, "no_prior_art", 0, "x"), (5, "No_Prior_Art ", 0, "x"), (6, None, 0, None), (7, "adjacent", None, None), (8, "adjacent", 1, "x")]
    rounds = [(c, k, f"a{k}", 0, "v") for c in (4, 5) for k in range(3)] + [(5, 9, "z", None, "w"), (8, 1, "Same", 1, None), (8, 2, " same", 1, None)]
    out = rm.refused(spark.createDataFrame(checks, "check long, verdict string, n_papers int, limits string"), spark.createDataFrame(rounds, "check long, round int, angle string, n_hits int, vocabulary string"))
    assert {r.check: r.why for r in out.collect()} == {1: "unknown verdict", 2: "prior work needs a paper", 3: "a negative needs its bounds", 4: "one vocabulary found nothing", 5: None, 6: None, 7: None, 8: "angles repeat"}


def test_ingest_and_caveats(spark):
    hits = [("q", 1, "a", "d", None, True, 5), ("q", 1, "b", " ", "", False, 1), ("q", None, "c", None, "p", False, 1)]
    r = rm.ingested(spark.createDataFrame(hits, "query string, run long, paper string, doi string, pmid string, is_new boolean, fetched_at long"), spark.createDataFrame([(1, 3)], "run long, started_at long")).first()
    assert (r.n_results, r.n_new, r.n_cached, r.n_reused, r.n_without_identifier, r.within_run_overlap, r.paper_reuse_rate) == (3, 1, 2, 1, 1, 0.667, 0.333)
    ideas = spark.createDataFrame([(1, "p", "A"), (2, "p", "B"), (3, "q", "C")], "idea long, project string, code string")
    reads = spark.createDataFrame([("p", "done", 10, 4, 3, 1, 1), ("p", "failed", 99, 0, 0, 2, 2)], "project string, status string, n_papers long, n_with_fulltext long, n_gap_sentences long, at long, id long")
    checks = spark.createDataFrame([(1, "adversarial", "scooped", 2, 2), (1, "adversarial", "adjacent", 1, 1), (2, "mechanical", "scooped", 9, 9)], "idea long, method string, verdict string, at long, id long")
    rounds = spark.createDataFrame([(1, 1, 0.1, 2, False, None), (1, 2, 0.3, 1, True, "cap")], "idea long, round int, drift double, n_open int, terminated boolean, reason string")
    got = {x.idea: x for x in rm.caveats_by_idea(ideas, reads, spark.createDataFrame([(1,), (2,), (2,)], "idea long"), checks, rounds).collect()}
    a, b, c = got[1], got[2], got[3]
    assert (a.n_papers, a.n_silent, a.n_gap_sentences, a.n_graded, a.n_unverified, a.n_done, a.done, a.n_rounds, a.drift, a.n_objections_open, a.terminated, a.reason) == (10, 6, 3, 2, 1, 1, ["A"], 2, 0.3, 1, True, "cap")
    assert (b.n_rounds, b.drift, b.n_done) == (0, None, 1) and (c.n_papers, c.n_graded, c.done) == (None, 0, [])


def test_lists_of_a_project_are_joined_last(spark):
    ideas = spark.createDataFrame([(1, "p", "B"), (2, "p", "A"), (3, "q", "C")], "idea long, project string, code string")
    reads = spark.createDataFrame([], "project string, status string, n_papers long, n_with_fulltext long, n_gap_sentences long, at long, id long")
    checks = spark.createDataFrame([(1, "adversarial", "scooped", 2, 2), (2, "adversarial", "scooped", 2, 2)], "idea long, method string, verdict string, at long, id long")
    rounds = spark.createDataFrame([], "idea long, round int, drift double, n_open int, terminated boolean, reason string")
    out = rm.caveats_by_idea(ideas, reads, ideas.select("idea"), checks, rounds)
    outer = out._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter, ")[1].split("\n")[0]
    assert "project" in outer and "idea" not in outer  # behind a join by idea every row of the shuffle would hold its project's list
    text = rm.caveats_by_idea(ideas, reads, ideas.select("idea"), checks, rounds, "|")
    assert {r.idea: r.done for r in text.collect()} == {1: "A|B", 2: "A|B", 3: ""}


CONCEPTS = [("Lung Neoplasms", ["lung  cancer", "cancer, lung", "Cancer of the Lung", "LUNG CANCER", ""]), (None, ["fine dust"]), ("", None), ("Asthma, Severe", [])]


@pytest.mark.parametrize("source, want", [
    ("pubmed", '("Lung Neoplasms"[MeSH Terms] OR "Cancer of the Lung"[tiab] OR "Lung Neoplasms"[tiab] OR "lung cancer"[tiab]) AND ("fine dust"[tiab]) AND ("Asthma, Severe"[MeSH Terms] OR "Asthma, Severe"[tiab])'),
    ("europepmc", '("Cancer of the Lung" OR "Lung Neoplasms" OR "lung cancer") AND ("fine dust") AND ("Asthma, Severe")'), ("arxiv", "Lung Neoplasms fine dust Asthma  Severe"),
])
def test_dialects(spark, source, want):
    rows = spark.createDataFrame([(CONCEPTS,), ([],)], "c array<struct<descriptor:string,terms:array<string>>>")
    assert [r[0] for r in rows.select(tx.rendered(F.col("c"), source)).collect()] == [want, ""]


def test_relatives_and_synonyms(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "b")], "ui string, broader string")
    paths = spark.createDataFrame([("a", "C.1.2.3.4"), ("b", "C.1.2.3"), ("c", "C.1.2"), ("b", "D.1")], "ui string, path string")
    assert [(r.ui, r.relative, r.relation, r.depth, r.place) for r in voc.relatives(edges, paths).orderBy("ui", "place").collect()] == [("a", "b", "broader", 4, 1), ("b", "a", "narrower", 5, 1), ("b", "x", "narrower", 0, 2), ("c", "b", "narrower", 4, 1), ("x", "b", "broader", 4, 1)]
    assert voc.relatives(edges, paths, want_broader=False).where("relation = 'broader'").count() == 0
    dictionary = spark.createDataFrame([("t lymphocytes regulatory", "D1"), ("anti platelet", "D2")], "gram string, ui string")
    extra = spark.createDataFrame([("T-Lymphocytes, Regulatory", "treg"), ("antiplatelet", "apt"), ("unknown", "x"), ("--", "y")], "spelling string, synonym string")
    assert sorted((r.ui, r.synonyms) for r in voc.by_concept(extra, dictionary).collect()) == [("D1", ["treg"]), ("D2", ["apt"])]


def test_the_first_name_that_answers(spark):
    entries = spark.createDataFrame([("D1", "breast cancer"), ("D2", "lung cancer")], "ui string, entry string")
    labels = spark.createDataFrame([("D1", "Breast Neoplasms"), ("D2", "Lung Neoplasms")], "ui string, label string")
    names = spark.createDataFrame([("zz", "NO RESULTS", 0), ("zz", "nothing like it", 1), ("zz", "lung cancer", 2), ("zz", "breast cancer", 3)], "term string, name string, place int")
    got = se.lookup(spark.createDataFrame([("zz",)], "term string"), entries, labels, names).collect()
    assert [(r.ui, r.via) for r in got] == [("D2", "synonym")]


def test_venues_as_they_stand(spark):
    for venue, want in (("The Lancet", 2), ("Lancet_X", 0), ("ab", 0), ("a_b", 1), ("Stroke", 1), ("Heat Stroke", 0), (" ", 0), (None, 0)):
        assert one(spark, evidence.venue_tier(F.col("v"), ["the lancet%", "%nature"], ["a_b", "stroke"]), v=venue) == want


def test_years_that_are_not_known(spark):
    for year, seed, want in ((0, 2020, 0.6), (2000, 0, 0.6), (2000, 2020, 1.0), (2018, 2020, 0.6)):
        roles = se.role_signals(F.col("n"), F.col("y"), F.col("s"), F.array(F.lit("a")), F.array(F.lit("b")))
        assert one(spark, roles["foundational"], n=1000, y=year, s=seed) == want


def test_structure_finds_its_key(spark):
    rows = [(k, f"p{k % 3}", f"2024-0{1 + k % 9}-1", "x") for k in range(9)]
    frame = spark.createDataFrame(rows, "row_id long, patient string, day string, note string")
    r = profile.detected(frame).first()
    assert (r["shape"], r["key"], r.n_groups, r.most_rows) == ("longitudinal", "patient", 3, 3) and "day" in r.why
    assert profile.detected(frame.drop("day")).first()["shape"] == "clustered"
    assert tuple(profile.detected(frame.drop("patient")).first()) == ("cross-sectional", None, None, None, "no identifier column repeats across rows")
    told = {r.name: r for r in profile.described(frame, {"time": ("day",)}).collect()}
    assert (told["day"].dtype, told["day"].first, told["day"].last, told["day"].joins_on) == ("date", "2024-01-1", "2024-09-1", "time")
    for value, want in (("2024-1", "date"), ("2024/12/31", "date"), ("20240131", "date"), ("2024-123", "text"), ("24-01-01", "text"), ("2024-01-01x", "text")):
        assert profile.described(spark.createDataFrame([(value,)], "c string")).first().dtype == want


def test_listings(spark):
    ideas = spark.createDataFrame([(1, "p", "live", 3), (2, "p", "done", 2), (3, "q", "live", None)], "idea long, project string, status string, created_at long")
    checks = spark.createDataFrame([(1, "r1", "scooped", None, 1, 1), (1, "r2", None, None, 2, 2)], "idea long, run string, verdict string, limits string, at long, id long")
    assert [(r.idea, r.run, r.verdict) for r in rm.listed_ideas(ideas, checks).collect()] == [(1, "r2", None), (2, None, None), (3, None, None)]
    assert [r.idea for r in rm.listed_ideas(ideas, checks, status="live", project="p").collect()] == [1]
    r = rm.overall(checks.limit(0), F.col("at") > 0, F.col("run")).first()
    assert (r["any"], r.last, r.n) == (None, None, 0)
    named = rm.named(spark.createDataFrame([("a",), ("b",)], "ui string"), spark.createDataFrame([("a", "A")], "ui string, label string"), spark.createDataFrame([("a", "T")], "ui string, type string"))
    assert sorted(map(tuple, named.collect())) == [("a", "A", ["T"]), ("b", "b", [])]


def test_moves_on_a_chain(spark):
    from papyrine.operators import chains, progress

    plan = progress.stages(spark, [(1, "a", None, False), (2, "b", "one", True), (3, "c", None, False)])
    schema = "run string, project string, stage string, status string, pause_after boolean, started_at long, finished_at long"
    none = spark.createDataFrame([], schema)

    def told(runs):
        return sorted((r.project, r.stage, r.status) for r in runs.collect())

    def ends(*rows):
        return spark.createDataFrame([(*r, 5) for r in rows], "project string, stage string, ok boolean, at long")

    first = chains.advanced(none, ends(("p", "a", True), ("q", "a", False), ("r", "x", True), ("s", "c", True)), plan)
    assert told(first) == [("p", "a", "done"), ("p", "b", "pending"), ("q", "a", "failed"), ("r", "x", "failed"), ("s", "c", "done")]
    parked = chains.advanced(first, ends(("p", "b", True)), plan)
    assert told(parked)[:2] == [("p", "a", "done"), ("p", "b", "awaiting_review")]
    on = spark.createDataFrame([("p", 9), ("q", 9)], "project string, at long")
    assert told(chains.resumed(parked, on, plan))[:3] == [("p", "a", "done"), ("p", "b", "done"), ("p", "c", "pending")]
    assert told(chains.stopped(parked, on))[:3] == [("p", "a", "done"), ("p", "b", "stopped"), ("q", "a", "failed")]
    marked = chains.pausing(first, spark.createDataFrame([("p", "b", False)], "project string, stage string, pause boolean"))
    assert ("p", "c", "pending") in told(chains.advanced(marked, ends(("p", "b", True)), plan))
    waits = spark.createDataFrame([("r1", "p", "b", "paused_budget", None, None, None)], schema)
    assert told(chains.resumed(waits, on, plan)) == [("p", "b", "pending")]  # it never ran
    twice = chains.advanced(first.unionByName(spark.createDataFrame([("r9", "p", "a", "running", None, 1, None)], schema)), ends(("p", "a", True)), plan)
    assert told(twice).count(("p", "b", "pending")) == 1
    assert told(chains.advanced(none, spark.createDataFrame([], "project string, stage string, ok boolean, at long"), plan)) == []
