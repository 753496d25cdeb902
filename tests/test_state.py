"""Rules, the watch over restarts, versions, backgrounds and file statistics, chains and the bridge experiment by hand."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from papyrine.operators import discovery, rules, search as se, triage
from papyrine.sources import background as bg, stored_state as st
from papyrine.streaming import collision

# --- rules


def test_rules_keep_what_cannot_be_decided(spark):
    rows = spark.createDataFrame([(1, 1, None, None), (2, None, None, None), (3, 1, 2, "x"), (4, None, 5, "y")], "id long, a long, b long, c string")
    some = (
        rules.Rule("t", "one side", "exactly one", ("a", "b")), rules.Rule("t", "word", "one of", ("c",), ("x",)), rules.Rule("t", "b with a", "required", ("b",), (), ("a", ())),
        rules.Rule("t", "small", "known and at least", ("a",), (1,), ("c", ("y",))),
    )
    got = {r.id: r.why for r in rules.judged(rows, some).collect()}
    assert got == {1: ["b with a"], 2: ["one side"], 3: ["one side"], 4: ["word", "small"]}
    good, bad = rules.split(rows, some)
    assert good.count() == 0 and bad.count() == 4 and "why" not in good.columns
    assert {r.rule: r.n_bad for r in rules.counts(rows.limit(0), some).collect()} == dict.fromkeys(("one side", "word", "b with a", "small"), 0)


def test_every_rule_compiles(spark):
    columns = sorted({c for r in rules.RULES for c in (*r.columns, *([r.when[0]] if r.when else []))})
    kinds = {"sections": "array<string>", "cutoff": "int", "rebuttal_score": "int", "drift": "double", "distance": "double", "round_no": "int", "usd_budget": "double", "usd_spent": "double"}
    rows = spark.createDataFrame([tuple(None for _ in columns)], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    broken = {r.rule for r in rules.counts(rows, rules.RULES).where("n_bad > 0").collect()}
    assert broken == {"left is one side", "right is one side", "ranked is one side"}


# --- the watch


def test_watch_over_restarts_and_late_rows(spark, tmp_path):
    schema, source, root = "topic long, key string, seq long", tmp_path / "in", f"file://{tmp_path}/watch"
    baseline = spark.createDataFrame([(1, "old")], "topic long, key string")

    def arrive(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{source}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
        return sorted((r.topic, r.key, r.seq) for r in collision.watch(spark, stream, baseline, root).collect())

    arrive("a", [(1, "old", 1), (1, "new", 3), (1, "new", 2), (2, "x", 1), (2, None, 1), (2, " ", 1)])
    first = run()
    assert first == [(1, "new", 2), (2, "x", 1)]
    arrive("b", [(1, "new", 9), (1, "old", 9), (3, "late", 0)])
    arrive("c", [(2, "x", 0), (3, "late", 1)])
    assert run() == [*first, (3, "late", 0)] and run() == [*first, (3, "late", 0)]
    days = sorted((r.batch, r.topic, r.n_seen, r.n_new, r.collision) for r in collision.history(spark, root).collect())
    assert len(days) == 6 and sum(d[3] for d in days) == 3 and (0, 2, 3, 1, True) in days and sum(not d[4] for d in days) == 3
    said = collision.admissible(spark.createDataFrame([("no_prior_art", 1), ("scooped", 0), ("scooped", 2), (None, 0)], "verdict string, n_new long"))
    assert [r.why is None for r in said.collect()] == [False, False, True, True]


def test_watchlist(spark):
    checks = spark.createDataFrame([("p", 1, "adversarial", "adjacent", 1, 1), ("p", 1, "adversarial", "scooped", 2, 2), ("p", 1, "mechanical", "x", 9, 9), ("p", 2, "mechanical", "x", 1, 1), ("p", 3, "adversarial", "adjacent", 1, 3)], "project string, topic long, method string, verdict string, at long, id long")
    ranks = spark.createDataFrame([(1, 5, 1, 1), (1, 2, 2, 2)], "topic long, rank long, at long, id long")
    watches = spark.createDataFrame([(3, 7, 1)], "topic long, at long, id long")
    assert [tuple(r) for r in collision.watchlist(checks, ranks, watches).orderBy("topic").select("topic", "baseline", "verdict", "place", "watched_at").collect()] == [(1, 2, "scooped", 2, None), (3, 3, "adjacent", None, 7)]
    assert [r.topic for r in collision.watchlist(checks, ranks, watches, 1).collect()] == [1]


# --- versions


def test_versions(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        st.read_version(spark, table)
    row = lambda v: spark.createDataFrame([(1, v), (2, "b")], "idea long, tier string")
    assert st.append_version(row("a"), table) == 0 and st.append_version(row("c"), table) == 1
    os.makedirs(tmp_path / "t/v2")  # a write that broke off
    assert st.append_version(row("c").unionByName(spark.createDataFrame([(3, "n")], "idea long, tier string")), table) == 2
    assert {r.tier for r in st.read_version(spark, table, 0).collect()} == {"a", "b"} and st.read_version(spark, table).count() == 3
    assert [tuple(r) for r in st.drift(spark, table, ["idea"], "tier").collect()] == [(1, 1, "c", "a")]
    with pytest.raises(FileNotFoundError):
        st.read_version(spark, table, 7)


# --- backgrounds and files


def test_dictionary_background_and_anchors(spark, tmp_path):
    whole = {"terms": {"lung": "D1"}, "labels": {"D1": "Lung"}, "semantic_types": {"D1": ["Body Part", "X"]}, "tree_numbers": {"D1": ["A04", "A04.1"]}}
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        json.dump(whole, f)
    got = {k: sorted(map(tuple, v.collect())) for k, v in bg.dictionary(spark, f"file://{tmp_path}/d.json.gz").items()}
    assert got == {"terms": [("lung", "D1")], "labels": [("D1", "Lung")], "types": [("D1", "Body Part"), ("D1", "X")], "paths": [("D1", "A04"), ("D1", "A04.1")]}
    with gzip.open(tmp_path / "b.json.gz", "wt") as f:
        json.dump({"n_papers": 50, "df": {"D1": 2, "D2": 1}}, f)
    rows = spark.createDataFrame([("D1",), ("D9",)], "ui string")
    for path, want in ((f"file://{tmp_path}/b.json.gz", {"D1": (0.04, True), "D9": (0.0, False)}), (f"file://{tmp_path}/none.json.gz", {"D1": (0.0, False), "D9": (0.0, False)}), (None, {"D1": (0.0, False), "D9": (0.0, False)})):
        assert {r.ui: (r.share, r.is_generic) for r in bg.with_share(rows, bg.background(spark, path)).collect()} == want
    (tmp_path / "published.json").write_text(json.dumps({"anchors": [{"external_id": "1", "title": "A", "term_groups": [["x"], ["y", "z"]]}]}))
    assert bg.anchors(spark, f"file://{tmp_path}", "published", ("published",)).first().term_groups == [["x"], ["y", "z"]]
    with pytest.raises(ValueError):
        bg.anchors(spark, f"file://{tmp_path}", "../published", ("published",))


def test_broadcast_only_below_a_checked_size(spark):
    rows = spark.range(1000)
    hinted = lambda most: "ResolvedHint" in bg.broadcastable(rows, most)._jdf.queryExecution().analyzed().toString()
    assert hinted(1 << 20) and not hinted(100)


def test_file_statistics(spark, tmp_path):
    spark.range(500).repartition(3).write.parquet(f"file://{tmp_path}/t")
    table = spark.read.parquet(f"file://{tmp_path}/t")
    r = bg.file_stats({"t": table}).first()
    sizes = [os.path.getsize(tmp_path / "t" / f) for f in os.listdir(tmp_path / "t") if f.endswith(".parquet")]
    assert (r.n_files, r.n_rows, r.n_bytes) == (3, 500, sum(sizes)) and r.row_bytes == round(sum(sizes) / 500, 2)
    assert "ReadSchema: struct<>" in bg.file_stats({"t": table})._jdf.queryExecution().executedPlan().toString()


# --- chains, the bridge experiment, similarity


def test_chains_stop(spark):
    works = spark.createDataFrame([(1, 10, 2000, ["a", "b"]), (2, 20, 2005, ["a", "b"]), (3, 5000, 2010, ["a"]), (4, None, 0, ["b"]), (5, 7, 1990, []), (6, 1, 2001, ["z"])], "work long, citations long, year int, tokens array<string>")
    edges = spark.createDataFrame([(2, 1), (4, 1), (3, 2), (1, 2), (1, 5), (1, 5), (6, 6), (1, 99)], "src long, dst long")
    rows, ends = se.chains(edges, works, works.where("work IN (1, 6)").select("work"), 4, 2)
    assert {r.chain: (r.steps, r.why) for r in ends.collect()} == {1: (2, "milestone"), 6: (1, "nothing onward")}
    got = [(r.step, r.way, r.neighbour, r["rank"], r.is_milestone) for r in rows.orderBy("step", "way", "rank").collect()]
    assert got == [(0, "backward", 2, 1, False), (0, "backward", 5, 2, False), (0, "forward", 2, 1, False), (0, "forward", 4, 2, False), (1, "backward", 1, 1, False), (1, "forward", 3, 1, True)]
    assert {r.why for r in se.chains(edges, works, works.where("work = 1").select("work"), 1, 2)[1].collect()} == {"depth"}


def controls_by_hand(found, pool, tries):
    spent, out = set(), []
    for item, freq in found:
        control, asked = None, 0
        for c, f, silent in sorted(pool, key=lambda p: (abs(p[1] - freq), p[0])):
            if c in spent:
                continue
            spent.add(c)
            asked += 1
            if silent:
                control = c
            if silent or asked == tries:
                break
        out.append((item, freq, control))
    return out


def test_controls(spark):
    import random

    rng = random.Random(8)
    pool = [(k, rng.randint(1, 30), rng.random() < 0.4) for k in range(100, 400)]
    found = sorted([(k, rng.randint(1, 30)) for k in range(12)], key=lambda x: (-x[1], x[0]))
    frame = spark.createDataFrame(pool, "item long, freq long, silent boolean").repartition(4)
    got = discovery.matched_controls(spark.createDataFrame(found, "item long, freq long"), frame, 3)
    assert [tuple(r) for r in got.collect()] == controls_by_hand(found, pool, 3)
    assert discovery.matched_controls(spark.createDataFrame(found, "item long, freq long").limit(0), frame).count() == 0


def test_experiment(spark):
    """Item 1 is the anchor, 2 and 3 link it to 10 to 19; of those that come to the anchor later the top has more."""
    uses = [(d, 1, True) for d in range(4)] + [(d, 2, True) for d in range(2)] + [(d, 3, True) for d in range(2, 4)]
    uses += [(100 + d, 2, True) for d in range(20)] + [(200 + d, 3, True) for d in range(20)]
    for k in range(10):
        uses += [(100 + d, 10 + k, True) for d in range(k + 1)] + ([(200 + d, 10 + k, True) for d in range(k + 1)] if k >= 5 else [])
    uses += [(300, 1, False), (300, 19, False), (300, 18, False), (300, 10, False), (301, 1, False), (301, 19, False)]
    frame = spark.createDataFrame(uses, "doc long, item long, is_before boolean")
    report, rows = discovery.experiment(frame, 1, most=2, scan=2, tries=2, least_docs=1, exclude=spark.createDataFrame([(17,)], "item long"))
    got = {(r.kind, r.item): (r.ltc, r.freq, r.before, r.after, r.hit) for r in rows.collect()}
    assert got == {("top", 19): (2, 20, 0, 2, True), ("top", 18): (2, 18, 0, 1, True), ("control", 16): (2, 14, 0, 0, False), ("control", 15): (2, 12, 0, 0, False)}
    r = report.first()
    assert (r.pool_size, r.n_excluded, r.n_scanned, r.top_hit_rate, r.control_hit_rate, r.verdict) == (9, 1, 2, 1.0, 0.0, "VOID")


def test_similarity_join_loses_no_pair(spark):
    import random

    rng = random.Random(2)
    texts = [[rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 14))] for _ in range(120)]
    texts += [[*t, "extra"] for t in texts[:20]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, w array<string>")
    rows, n = triage.token_rows(docs, F.col("w")), docs.agg(F.count("*").alias("n"))
    every = {(r.a, r.b): r for r in triage.similar_pairs(rows, n, 0.0).collect()}
    assert set(every) == {(a, b) for a in range(140) for b in range(a + 1, 140) if set(texts[a]) & set(texts[b])}
    for least in (0.35, 0.6, 0.9):
        got = {(r.a, r.b) for r in triage.similar_pairs(rows, n, least).where(F.col("score") >= least).collect()}
        assert got == {k for k, r in every.items() if r.score >= least}
    some = {(r.a, r.b) for r in triage.similar_pairs(rows, n, 0.5, 0.0, 1.0).where("jaccard >= 0.5").collect()}
    assert some == {k for k, r in every.items() if r.jaccard >= 0.5}
    top = triage.near_duplicates(docs, F.col("w"), 2.0, 30).collect()  # none at the threshold: the bound falls
    assert sorted(r.score for r in top) == sorted(r.score for r in every.values())[-30:] and not any(r.above for r in top)


def test_similarity_join_of_long_texts(spark):
    """Signatures of hundreds of tokens, in which every bit occurs: no pair is lost."""
    import random

    rng = random.Random(5)
    texts = [rng.sample([f"w{k}" for k in range(3000)], rng.randint(150, 300)) for _ in range(150)]
    texts += [[*t[: len(t) - cut], *(f"x{cut}y{j}" for j in range(cut))] for cut in (5, 30, 60) for t in texts[:40]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, w array<string>")
    rows, n = triage.token_rows(docs, F.col("w")), docs.agg(F.count("*").alias("n"))
    sets = [set(t) for t in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    got = {(r.a, r.b) for r in triage.similar_pairs(rows, n, 0.5, 0.0, 1.0).where("jaccard >= 0.5").collect()}
    assert got == want and len(want) >= 120
    every = {(r.a, r.b): r.score for r in triage.similar_pairs(rows, n, 0.0).collect()}
    assert {(r.a, r.b) for r in triage.similar_pairs(rows, n, 0.6).where("score >= 0.6").collect()} == {k for k, v in every.items() if v >= 0.6}
