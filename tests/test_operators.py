"""Edge cases of the operators on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from papyrine.functions import measures, text as tx
from papyrine.operators import corpus, discovery, profile, progress, relational as rel, triage, vocabulary as voc
from papyrine.sources import records, sinks
from papyrine.streaming.watch import current, first_seen, merge_late, versions


def one(spark, column, **values):
    """A column over one row of values."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, kinds(values.values()))))
    return df.select(column.alias("x")).first()[0]


def kinds(values):
    return ["array<string>" if isinstance(v, list) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string" for v in values]


@pytest.mark.parametrize("text, want", [("The gene-2 of DNA x", ["gene-2", "dna"]), ("東京都 a", ["東京", "京都"]), ("京", []), ("", []), (None, None)])
def test_tokens(spark, text, want):
    assert one(spark, tx.tokens(F.col("t")), t=text) == want


@pytest.mark.parametrize("term, label, want", [("Lung", "lung", 100), ("lung cancer", "Cancer, Lung", 90), ("lung", "Lung Neoplasms", 80), ("lung", "Acute Lung Injury", 70), ("lung cancer", "Lung Machine", 40), ("heart", "Lung", 0), ("of the", "Lung", 0)])
def test_label_score(spark, term, label, want):
    assert one(spark, tx.label_score(tx.label_tokens(F.col("a")), tx.label_tokens(F.col("b"))), a=term, b=label) == want


def test_keys(spark):
    assert one(spark, tx.title_key(F.col("t")), t="Café — a Study!") == "cafe a study"
    assert one(spark, tx.title_key(F.col("t")), t="東京") is None and one(spark, tx.squashed(F.col("t")), t="東京") is None
    assert one(spark, tx.doi(F.col("t")), t="https://doi.org/10.1/ABC") == "10.1/abc"
    assert one(spark, tx.identity(F.col("a"), F.col("b"), F.col("c")), a="", b="12", c="T") == "pmid:12"
    assert one(spark, tx.identity(F.col("a"), F.col("b"), F.col("c")), a=None, b=" ", c="A Title") == "a title"
    assert one(spark, tx.one_space(F.col("t")), t=" A\t b") == " a b"


def test_text_helpers(spark):
    assert one(spark, tx.shared_depth(F.col("a"), F.col("b")), a="C04.588.1", b="C04.588.2.7") == 2
    assert one(spark, tx.wide_length(F.col("t")), t="ab東京") == 6
    assert one(spark, tx.distinct_caseless(F.col("t")), t=["Lung", "lung", "Heart"]) == ["Lung", "Heart"]
    assert one(spark, tx.section(F.col("t"), "Discussion"), t="<body><h2>Discussion</h2><p>We  saw</p><h2>End</h2>") == "We saw"
    assert one(spark, tx.section(F.col("t"), "Discussion"), t="<p>x</p>") is None
    found = one(spark, tx.gap_sentences(F.col("t")), t="Short. The mechanism of this effect remains unclear and is a matter for later work. Nothing to see in this sentence, which is long enough to count but has none.")
    assert len(found) == 1 and "unclear" in found[0]


def test_measures(spark):
    assert one(spark, measures.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 0.0
    assert one(spark, measures.rate(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, measures.expectation(F.col("a"), F.col("b")), a=1000.0, b=1000.0) == 0.5
    lit = F.lit
    usd = measures.price(lit(5.0), lit(25.0), lit(1000), lit(1000), lit(None).cast("long"), lit(1000), lit(True))
    assert one(spark, usd, a=1) == pytest.approx(0.018125)
    with pytest.raises(Exception, match="no price"):
        one(spark, measures.price(lit(None).cast("double"), lit(1.0), lit(1), lit(1), lit(0), lit(0), lit(False)), a=1)


def test_merged_records(spark):
    kind = "rec long, source string, src_rank int, doi string, title_key string, title string, citations long, year int"
    rows = [(1, "a", 0, "d1", "t1", "T1", None, 2001), (2, "b", 0, "d1", None, "T1 b", 5, None), (3, "c", 2, None, "t1", None, 7, 1999), (4, "a", 1, "d2", "t2", "X", 1, None), (5, "b", 1, "d3", "t2", "X", 2, None), (6, "c", 9, None, None, None, None, None)]
    got = {r.work: r for r in corpus.merged(spark.createDataFrame(rows, kind)).collect()}
    assert {k: r.n_records for k, r in got.items()} == {1: 3, 4: 1, 5: 1, 6: 1}  # works with different DOIs stay apart though they share a title
    assert got[1].also_in == ["a", "b", "c"] and got[1].citations == 7 and got[1].year == 2001 and got[6].citations == 0


def test_clusters_and_survivors(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (6, 7), (7, 6), (9, 9)], "a long, b long")
    root = {r.node: r.root for r in triage.clusters(pairs).collect()}
    assert root == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6}
    members = spark.createDataFrame([(1, 1, None, False, 2, 5), (1, 2, "B", False, 3, 9), (1, 3, "A", False, 3, 9), (6, 6, "C", True, 0, 1), (6, 7, "D", False, 9, 0)], "root long, id long, code string, pinned boolean, completeness int, created int")
    assert {r.id for r in triage.survivors(members).where("survives").collect()} == {3, 6}


def test_schedule_isolates_batches(spark):
    players = spark.createDataFrame([(5, i, i in (0, 1)) for i in range(7)], "tournament long, id long, is_anchor boolean")
    games = triage.schedule(players, 4, F.xxhash64(F.lit(3), "l", "r")).collect()
    assert len(games) == 2 * 20 and not any({g.l, g.r} == {0, 1} for g in games)
    halves = {}
    for g in games:
        halves.setdefault(frozenset((g.l, g.r)), []).append(g.batch)
    assert all(len(set(b)) == 2 for b in halves.values()) and max(list(map(lambda g: g.batch, games)).count(b) for b in range(10)) == 4


def test_ratings_fold_in_order(spark):
    rows = [(1, k, 1, 2, w) for k, w in enumerate(["l", "r", "tie"])]
    got = {r.id: r.elo for r in triage.ratings(spark.createDataFrame(rows, "tournament long, seq long, l long, r long, winner string")).collect()}
    a = b = 1000.0
    for w in (1, 0, 0.5):
        e = 1 / (1 + 10 ** ((b - a) / 400))
        a, b = a + 32 * (w - e), b - 32 * (w - e)
    assert got == {1: round(a, 1), 2: round(b, 1)}


def test_unknown_rounds_do_not_break_a_run(spark):
    rows = [(1, k, h) for k, h in enumerate([0, None, 0, 3, 0, None])] + [(2, 0, None)]
    got = {r.topic: r.longest for r in discovery.longest_empty_run(spark.createDataFrame(rows, "topic long, seq long, n_hits long")).collect()}
    assert got == {1: 2}


def test_leftmost_longest(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c", "d", "b"]), (2, [])], "id long, w array<string>")
    terms = spark.createDataFrame([("a b", "u1", False), ("b c d", "u2", True), ("c", "u3", True), ("b", "u4", True)], "gram string, ui string, informative boolean")
    got = sorted((r["at"], r.ui) for r in voc.concepts(docs, F.col("w"), terms, 3).collect())
    assert got == [(3, "u3"), (5, "u4")]  # the uninformative 'a b' consumes b, so 'b c d' cannot start there


def test_crossing_order(spark):
    rows = [(1, 0, k, f"a{k}") for k in range(4)] + [(1, 1, k, f"b{k}") for k in range(4)]
    got = [r.query for r in voc.crossed(spark.createDataFrame(rows, "plan long, concept int, place int, term string"), 4).orderBy("total", "query").collect()]
    assert got == ["a0 AND b0", "a0 AND b1", "a1 AND b0", "a0 AND b2"]


def test_chain_state(spark):
    plan = progress.stages(spark, [(1, "a", None, False), (2, "b", "x", True), (3, "c", None, False)])
    rows = [(1, "b", "awaiting_review", 5), (2, "b", "awaiting_review", 5), (2, "c", "done", 9), (3, "b", "awaiting_review", 5), (3, "c", "done", 4), (4, "a", "failed", 1), (5, "a", "done", 1), (6, "a", "stopped", 1), (6, "b", "failed", 2)]
    got = {r.project: r.state for r in progress.chain_state(spark.createDataFrame(rows, "project long, stage string, status string, finished_at long"), plan, "c").collect()}
    assert got == {1: "awaiting_you", 2: "done", 3: "awaiting_you", 4: "failed", 5: "idle", 6: "failed"}


def test_upsert_policies(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "k long, p string, q string")
    new = spark.createDataFrame([(2, "", "z"), (3, "c", None)], "k long, p string, q string")
    got = {r.k: tuple(r)[1:] for r in rel.upsert(old, new, ["k"], {"p": "filled", "q": "existing"}).collect()}
    assert got == {1: ("a", "x", False), 2: (None, "y", False), 3: ("c", None, True)}


def test_citations_conflict(spark):
    pool = spark.createDataFrame([(1, "10.1/A", "5"), (2, None, "6")], "paper long, doi string, pmid string")
    claims = spark.createDataFrame([(1, "10.1/a", "5"), (2, "10.1/a", "6"), (3, None, "6"), (4, None, None)], "c long, doi string, pmid string")
    assert {r.c: (r.state, r.paper) for r in rel.cited(claims, pool).collect()} == {1: ("verified", 1), 2: ("conflict", 1), 3: ("verified", 2), 4: ("unknown", None)}


def test_profile(spark):
    df = spark.createDataFrame([(str(i), f"a{i}@b.org", "2024-01-0%d" % (i % 9 + 1), "", str(i % 3), "x" * 100 if i % 2 else "y") for i in range(1, 21)], "id string, contact string, day string, gap string, lvl string, note string")
    got = {r.name: r for r in profile.columns(df).collect()}
    assert {n: r.dtype for n, r in got.items()} == {"id": "integer", "contact": "text", "day": "date", "gap": "empty", "lvl": "integer", "note": "text"}
    assert got["contact"].personal and got["note"].personal and not got["lvl"].personal
    assert got["gap"].missing_rate == 1.0 and got["id"].unique_per_row and (got["lvl"]["min"], got["lvl"]["max"]) == (0, 2)
    assert {r.name for r in profile.levels(df).collect()} == {"day", "lvl"}
    assert profile.structure(df, "lvl", False).first().shape == "clustered" and profile.structure(df, "id", True).first().shape == "cross-sectional"


ARTICLE = """<PubmedArticle><PMID>77</PMID><Journal><Title>J Tests</Title><PubDate><MedlineDate>2019 Jan-Feb</MedlineDate></PubDate></Journal><ArticleTitle>On <i>in vivo</i> tests.</ArticleTitle>
<Abstract><AbstractText Label="A">One.</AbstractText><AbstractText>Two.</AbstractText></Abstract><Author><LastName>Roe</LastName><Initials>J</Initials></Author><PublicationType>Review</PublicationType>
<MeshHeading><DescriptorName>Lung</DescriptorName></MeshHeading><MeshHeading><DescriptorName>LUNG</DescriptorName></MeshHeading><ArticleId IdType="doi">10.1/X</ArticleId></PubmedArticle>"""


def test_record_formats(spark):
    r = records.article_xml(spark.createDataFrame([(ARTICLE,)], "xml string")).first()
    assert (r.pmid, r.doi, r.title, r.abstract, r.year, r.venue, r.authors) == ("77", "10.1/x", "On in vivo tests.", "One. Two.", 2019, "J Tests", ["Roe J"])
    assert one(spark, records.descriptors("xml"), xml=ARTICLE) == ["Lung"]
    doc = json.dumps({"id": "1", "doi": "10.1/Y", "title": "T", "pubYear": "2020", "authorString": "A B, C D", "journalInfo": {"journal": {"title": ""}}, "journalTitle": "V", "meshHeadingList": {"meshHeading": [{"descriptorName": "Lung"}, {"descriptorName": None}]}})
    r = records.europe_json(spark.createDataFrame([(doc,)], "json string")).first()
    assert (r.doi, r.venue, r.year, r.authors) == ("10.1/y", "V", 2020, ["A B", "C D"]) and one(spark, records.europe_descriptors("json"), json=doc) == ["Lung"]
    r = records.work_json(spark.createDataFrame([(json.dumps({"id": "W1", "title": "T", "abstract_inverted_index": {"b": [1], "a": [0, 2]}}),)], "json string")).first()
    assert r.abstract == "a b a"
    r = records.crossref_json(spark.createDataFrame([(json.dumps({"DOI": "10.2/Z", "title": ["T"], "issued": {"date-parts": [[2011, 2]]}, "author": [{"given": "A", "family": "B"}]}),)], "json string")).first()
    assert (r.doi, r.year, r.authors) == ("10.2/z", 2011, ["A B"])
    entries = [("<entry><id>http://x/abs/1</id><title>T</title><published>2010-01-01</published><author><name>A</name></author></entry>",), ("<entry><id>http://x/abs/2</id><title>U</title></entry>",)]
    assert [x.id for x in records.atom(spark.createDataFrame(entries, "xml string"), year_from=2015).collect()] == ["2"]


def test_xml_is_parsed_once(spark):
    """All fields come from one parse, a filter on them included, with the values that xpath gives."""
    texts = [ARTICLE, "<a:b><PMID> </PMID><x:PMID>9</x:PMID><ArticleId IdType='doi'><![CDATA[10.1/<Z>]]></ArticleId><Author><LastName>A&amp;B<sup>1</sup>C</LastName></Author><PublicationType/></a:b>", "<PMID>5<i>6</i></PMID>", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "xml string")
    own = df.select(records.ARTICLE(F.col("xml")).alias("r"), F.xpath_string("xml", F.lit("//PMID")).alias("pmid"), F.xpath_string("xml", F.lit("//ArticleId[@IdType='doi']")).alias("doi"), F.xpath("xml", F.lit("//Author/LastName/text()")).alias("last"), F.xpath("xml", F.lit("//PublicationType/text()")).alias("types"))
    assert all((r.r.pmid, r.r.doi, r.r.last, r.r.types) == (r.pmid, r.doi, r["last"], r.types) for r in own.collect())
    r = records.article_xml(df.limit(1), headings=True).first()
    assert (r.headings, r.pmid) == (["Lung"], "77")
    for made in (records.article_xml(df, headings=True), records.atom(df, year_from=2015)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "xpath" not in plan


def test_vocabulary_builder(spark):
    rec = lambda u, *t: (f"<DescriptorRecord><DescriptorUI>{u}</DescriptorUI><DescriptorName><String>{t[0]}</String></DescriptorName>" + "".join(f"<Term><String>{x}</String></Term>" for x in t) + "</DescriptorRecord>",)
    _, terms = records.vocabulary_xml(spark.createDataFrame([rec("D1", "Lung", "Pulmo", "Both"), rec("D2", "Heart", "Both", "abc")], "xml string"))
    assert {tuple(r) for r in terms.select("term", "ui").collect()} == {("lung", "D1"), ("pulmo", "D1"), ("heart", "D2")}
    more = spark.createDataFrame([("lung", "S1"), ("good name", "S2"), ("12345678", "S3"), ("abc", "S4")], "term string, ui string")
    assert {r.ui for r in records.supplemented(terms.select("term", "ui"), more).collect()} == {"D1", "D2", "S2"}


def test_files(spark, tmp_path):
    (tmp_path / "p.md").write_text("# Title\n\n## One\nfirst\n\n## Two\nsecond\n")
    r = records.packs(spark, str(tmp_path / "p.md")).withColumn("s", records.pack_section(F.col("content"), "One")).first()
    assert (r["name"], r.title, r.s) == ("p", "Title", "first") and len(r.sha256) == 64
    (tmp_path / "t.csv").write_text("﻿a;b\n1;2\n3\n", encoding="utf-8")
    assert [tuple(r) for r in records.delimited(spark, str(tmp_path / "t.csv")).collect()] == [("1", "2"), ("3", None)]
    (tmp_path / "i.json").write_text('[{"title": "x"},\n {"id": "k", "title": "y"}]')
    assert [r.id for r in records.ideas(spark, str(tmp_path / "i.json")).collect()] == ["i01", "k"]
    lines = tmp_path / "lines"
    spark.range(6).selectExpr("concat('{\"title\": \"', id, '\"}') AS value").repartition(3).write.text(str(lines))
    assert sorted(r.id for r in records.ideas(spark, str(lines)).collect()) == [f"i0{k}" for k in range(1, 7)]  # dense over partitions
    (tmp_path / "ty.txt").write_text("D1|T2\nD1|T1\n")
    assert records.typed(spark, str(tmp_path / "ty.txt")).first().types == ["T1", "T2"]
    table = {"a": spark.range(3), "b": spark.range(0)}
    sinks.snapshot(table, str(tmp_path / "snap"))
    assert all(r.same for r in sinks.restore_drill(spark, table, str(tmp_path / "snap")).collect())
    blocks = spark.createDataFrame([(1, 2, "item", "x"), (1, 1, "title", "T")], "doc long, ord int, kind string, text string")
    assert sinks.markdown(blocks).first().markdown == "# T\n\n- x"
    assert sinks.as_json(spark.range(1)).first()[0] == '{"id":0}'


def test_watch_never_forgets(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def arrive(k, values):
        spark.createDataFrame([(v,) for v in values], "key long").coalesce(1).write.mode("append").parquet(str(source))
        q = first_seen(spark.readStream.schema("key long").parquet(str(source)), ["key"]).writeStream.format("parquet").option("path", sink).option("checkpointLocation", sink + ".p").trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(r.key for r in spark.read.parquet(sink).collect()) == k

    arrive([1, 2], [1, 2, 2])
    arrive([1, 2, 3], [3])
    arrive([1, 2, 3], [1])


def test_late_merge_keeps_the_version_before(spark, tmp_path):
    source, table = tmp_path / "late", str(tmp_path / "table")
    source.mkdir()
    spark.createDataFrame([(1, "a"), (2, "b")], "key long, v string").write.parquet(f"{table}/v0")
    merge = lambda old, new: rel.upsert(old, new, ["key"], {"v": "filled"}).select("key", "v")
    for k, rows in enumerate([[(2, "x"), (3, "c")], [(4, "d")], [(5, None)]]):
        spark.createDataFrame(rows, "key long, v string").coalesce(1).write.mode("append").parquet(str(source))
        merge_late(spark, spark.readStream.schema("key long, v string").parquet(str(source)), table, merge)
        assert versions(spark, table)[-2:] == [k, k + 1]
    assert sorted(map(tuple, current(spark, table).collect())) == [(1, "a"), (2, "x"), (3, "c"), (4, "d"), (5, None)]
    assert versions(spark, table) == [2, 3]
    (tmp_path / "table" / "v3" / "_SUCCESS").unlink()  # a write that was not committed does not count
    assert current(spark, table).count() == 4


def test_controls_spend_candidates(spark):
    found = spark.createDataFrame([(1, 10), (2, 10)], "item long, freq long")
    pool = spark.createDataFrame([(7, 10), (8, 12), (9, 50)], "item long, freq long")
    assert {r.item: r.control for r in discovery.matched_controls(found, pool).collect()} == {1: 7, 2: 8}


def test_controls_pass_over_and_spend(spark):
    """A candidate that is not silent is spent; after `tries` of them an item stays without a control."""
    found = spark.createDataFrame([(1, 10), (2, 10), (3, 10)], "item long, freq long")
    pool = spark.createDataFrame([(5, 10, False), (6, 10, False), (7, 11, True), (8, 12, False), (9, 13, False), (10, 14, True)], "item long, freq long, silent boolean")
    got = {r.item: r.control for r in discovery.matched_controls(found, pool, tries=3).collect()}
    assert got == {1: 7, 2: 10, 3: None}
    got = {r.item: r.control for r in discovery.matched_controls(found, pool, tries=2).collect()}
    assert got == {1: None, 2: 7, 3: None}


def test_gate_is_void_without_a_ratio(spark):
    rows = lambda a, b: spark.createDataFrame([("top", x, 1) for x in a] + [("control", x, 2) for x in b], "kind string, hit boolean, ltc int")
    said = lambda a, b: discovery.gate(rows(a, b)).first().verdict
    assert said([True, True], [True, False, False, False]) == "PASS" and said([True, False], [True, False, False]) == "FAIL"
    assert said([True], [True, True]) == "VOID" and said([True], [False]) == "VOID" and said([], []) == "VOID"


def test_search_survives_its_sources(spark):
    from papyrine.operators import search

    def down():
        raise TimeoutError("late")

    works, tried = search.search(spark, {"a": down, "b": None})
    assert works.count() == 0 and [(r.source, r.answered, r.error) for r in tried.collect()] == [("a", False, "TimeoutError: late"), ("b", False, "LookupError: unknown source")]


def test_lookup_rungs(spark):
    from papyrine.operators import search

    labels = spark.createDataFrame([("D1", "Lung Cancer"), ("D2", "Heart-Attack"), ("D3", "Stroke Volume")], "ui string, label string")
    entries = spark.createDataFrame([("D2", "myocardial infarction")], "ui string, entry string")
    synonyms = spark.createDataFrame([("apoplexy", "stroke"), ("stroke", "unused")], "term string, name string")
    terms = spark.createDataFrame([(x,) for x in ("cancer lung", "Myocardial infarction", "heartattack", "apoplexy", "stroke", "nothing")], "term string")
    got = {(r.term, r.ui, r.via) for r in search.lookup(terms, entries, labels, synonyms).collect()}
    assert got == {("cancer lung", "D1", "label"), ("Myocardial infarction", "D2", "entry"), ("heartattack", "D2", "normalised"), ("apoplexy", "D3", "synonym"), ("stroke", "D3", "label")}


def test_anchor_guards_and_list_of_missing(spark):
    from papyrine.operators import evidence

    rows = [(None, " a ", None, ["x"], "2019"), ("1", "b", "o", [], "soon"), ("2", " ", "o", None, "1799"), ("3", "c", "o", None, "2101")]
    got = evidence.guarded(spark.createDataFrame(rows, "external_id string, title string, origin string, term_groups array<string>, cutoff string")).collect()
    assert [(r.title, r.origin, r.term_groups, r.cutoff) for r in got] == [("a", "local", ["x"], 2019), ("b", "o", None, None), ("c", "o", None, None)]
    graded = spark.createDataFrame([(1, "A", "one", "r", 1, 1), (1, "B", None, "r", 2, 2)], "idea int, tier string, missing string, route string, at int, id int")
    assert evidence.acquisition(graded).first().missing == []
    assert evidence.acquisition(graded.where("at = 1")).first().missing == ["one"]


def test_concept_history(spark):
    from papyrine.operators import evidence

    rows = [(1, [("t1", [("stroke", None, False)]), ("t2", [("stroke", "Stroke", True), ("diet", "Diet", True)])])]
    frame = spark.createDataFrame(rows, "project int, versions array<struct<at string, concepts array<struct<input string, descriptor string, expanded boolean>>>>")
    assert sorted((r.input, r.descriptor, r.expanded, r.last_version, r.since, r.n_versions) for r in evidence.concept_history(frame).collect()) == [("diet", "Diet", True, 1, "t2", 1), ("stroke", "Stroke", True, 1, "t1", 2)]
