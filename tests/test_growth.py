"""What must not grow: rows in one task, texts made again, shuffles of what stays in its row."""

from pathlib import Path

from pyspark.sql import functions as F

from papyrine.functions import text as tx
from papyrine.operators import discovery, harvest, readmodels as rm, triage, vocabulary as voc
from papyrine.plans import catalog, literature
from papyrine.session import shared_folder
from tests.conftest import DATA

catalog.load()


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_inverted_in_its_row(spark):
    """the index of a text is made without a shuffle."""
    df = spark.createDataFrame([(["b", "a", "b", "B"],), ([],), (None,)], "ws array<string>")
    got = [r.m for r in df.select(tx.inverted(F.col("ws")).alias("m")).collect()]
    assert got == [{"b": [0, 2], "a": [1], "B": [3]}, {}, None]
    assert "Exchange" not in plan(catalog.QUERIES["inverted_abstract"](spark, DATA))


def test_pieces_of_batches():
    """F16, F21: few words become Python objects at once, and every row comes."""
    import pyarrow as pa

    lists = [["x"] * 5] * 7 + [None, [], ["y"] * 40, ["z"]]
    got = list(voc.pieces([pa.RecordBatch.from_pydict({"w": pa.array(lists, pa.list_(pa.string()))})], 10))
    assert [w for b in got for w in b.column("w").to_pylist()] == lists
    assert len(got) > 3 and all(sum(map(len, filter(None, b.column("w").to_pylist()[1:]))) <= 10 for b in got)


def test_papers_without_key_are_spread(spark):
    """papers that lack an identifier do not all go to one task."""
    papers = spark.range(400).selectExpr("id AS paper", "CASE WHEN id = 7 THEN 'p7' END AS pmid", "CASE WHEN id = 8 THEN 'D8' END AS doi")
    links = spark.createDataFrame([("p7", None, "a"), (None, "d8", "b")], "pmid string, doi string, pmcid string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = harvest.resolved_ids(papers, links).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    assert len(got) == 400 and {r.paper: r.found for r in got if r.found} == {7: "a", 8: "b"}
    sizes = [sum(r.task == k for r in got) for k in {r.task for r in got}]
    assert max(sizes) < 250


def test_tokens_below_the_explode(spark):
    """the first line's tokens are not made again for every token."""
    above = plan(literature.marked_postings(catalog.Tables(spark, DATA)), "optimizedPlan").split("Generate")
    assert len(above) == 2 and "regexp_extract_all" not in above[0] + above[1].split("\n")[0]


def test_postings_are_read_once(spark):
    """verdicts reads the postings once, and only what is asked for stays."""
    postings = spark.range(12).selectExpr("id % 6 AS doc", "CASE WHEN id < 6 THEN 'a' ELSE 'b' END AS term", "id % 2 = 0 AS is_before")
    got = discovery.verdicts(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "a"), (3, "b")], "direction int, term string"), postings, 3, 3)
    assert "Range (" not in plan(got)
    assert {(r.direction, r.n_terms, r.rarest, r.before, r.after, r.verdict) for r in got.collect()} == {(1, 2, 6, 3, 3, "ALREADY DONE"), (2, 2, 0, 0, 0, "TERM TOO RARE"), (3, 1, 6, 3, 3, "SINGLE GROUP")}


def test_schedule_over_several_fields(spark, monkeypatch):
    """no window spans a tournament's pairs, and the batches are those of one sorted list."""
    monkeypatch.setattr(triage, "FIELD", 4)
    ids = [3 * i for i in range(19)] + [9]  # one twice
    players = spark.createDataFrame([(t, i, i % 5 == 0) for t in (1, 2) for i in ids[: 20 - t]], "tournament int, id long, is_anchor boolean")
    made = triage.schedule(players, 7, (F.col("l") * 31 + F.col("r") * 17) % 11)
    want = []
    for t in (1, 2):
        own = ids[: 20 - t]
        pairs = sorted(((a * 31 + b * 17) % 11, a, b) for a in own for b in own if a < b and not (a % 5 == 0 and b % 5 == 0))
        shift = -(-len(pairs) // 7)
        want += [(t, a, b, k // 7) for k, (_, a, b) in enumerate(pairs)] + [(t, b, a, k // 7 + shift) for k, (_, a, b) in enumerate(pairs)]
    assert sorted(map(tuple, made.collect())) == sorted(want)
    windows = [x for x in plan(made, "optimizedPlan").split("\n") if "Window [" in x]
    assert windows and all("field" in x.split("windowspecdefinition(")[1] for x in windows)


def test_walk_meets_few_neighbours(spark):
    """of a hub's neighbours only as many go on as a seed could keep; the steps are those of the whole lists."""
    edges = spark.range(2000).selectExpr("id AS src", "100000 + id % 3 AS dst")
    weight = spark.range(2000).selectExpr("id AS node", "id % 50 AS score")
    got = discovery.walk(edges, spark.createDataFrame([(0,), (7,)], "node long"), 3, 2, weight)
    near = {n: sorted((x for x in range(2000) if x % 3 == n), key=lambda x: (-(x % 50), x)) for n in range(3)}
    want = set()
    for seed in (0, 7):
        second = [x for x in near[seed % 3] if x != seed][:2]
        want |= {(seed, seed, 0), (seed, 100000 + seed % 3, 1), *((seed, x, 2) for x in second)}
    assert {tuple(r) for r in got.collect()} == want
    assert "Range (" not in plan(got)


def test_tokens_are_dealt_as_arrays(spark):
    """the tokens of a text are shuffled as one row, and their weights need no further one where the frequencies are few."""
    whole = plan(catalog.QUERIES["tfidf_top_terms"](spark, DATA))
    assert whole.count("Exchange hashpartitioning") == 1 and "_ts" in whole.split("Exchange hashpartitioning")[1]


def test_vectors_go_once_to_a_family(spark):
    """of a family of near copies a document is sent to the scoring once, not once a pair; a large family is dealt to several cells."""
    pairs = spark.range(60).selectExpr("id AS a").join(spark.range(60).selectExpr("id AS b")).where("a < b AND a % 2 = b % 2")
    met = triage.placed(pairs).collect()
    assert {(r.a, r.b) for r in met} == {(a, b) for a in range(60) for b in range(a + 2, 60, 2)} and all(r.x <= r.y for r in met)
    assert len({(r.x, r.y, i) for r in met for i in (r.a, r.b)}) == 60


def test_scores_over_several_cells(spark, monkeypatch):
    """F1, F2, F3: cells of a few documents, buckets of a few tokens and small heaps of pairs give the scores of every pair."""
    import random

    rng = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    texts = [[*rng.sample(base, 50), *rng.choices(base, k=5), f"own{i}"] for i in range(30)] + [["alone", "never"], ["w1"], []]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, w array<string>")
    rows, n = triage.token_rows(docs, F.col("w")), docs.agg(F.count("*").alias("n"))
    whole = {(r.a, r.b): (r.cosine, r.jaccard, r.score) for r in triage.similar_pairs(rows, n, 0.0).collect()}
    monkeypatch.setattr(triage, "CELL", 4)
    parts = {(r.a, r.b): (r.cosine, r.jaccard, r.score) for r in triage.similar_pairs(rows, n, 0.0).collect()}
    assert parts == whole
    sets = [set(t) for t in texts]
    assert {k: round(len(sets[k[0]] & sets[k[1]]) / len(sets[k[0]] | sets[k[1]]), 6) for k in whole} == {k: v[1] for k, v in whole.items()}
    assert set(whole) == {(a, b) for a in range(33) for b in range(a + 1, 33) if sets[a] & sets[b]}


def test_long_texts_are_told_apart(spark, monkeypatch):
    """signatures grow with the text, so fewer long texts of one vocabulary are candidates; near copies are, also of one at another level."""
    import random

    rng = random.Random(3)
    texts = [[] for _ in range(40)]
    for k in range(9000):
        for i in rng.sample(range(40), 5):
            texts[i].append(f"w{k}")
    assert min(map(len, texts)) > 1024
    texts += [t[:k] for t, k in zip(texts[:12], range(970, 1018, 4), strict=True)] + [["f"]] * 1000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, w array<string>")
    ranked = triage.stored(triage.ranked_tokens(triage.token_rows(docs, F.col("w")), docs.agg(F.count("*").alias("n"))))
    assert [int(triage.levels(triage.np.array([k]))[0]) for k in (512, 513, 1020, 1050)] == [0, 1, 1, 2]

    table = ranked.where("id < 52").select("id", "n", F.transform("token", lambda t: F.xxhash64(t)).alias("token"), "df", "w").orderBy("id").toArrow().combine_chunks()

    def found():
        made = triage.heads(table.to_batches(), 1, 0.599, triage.COSINE, triage.JACCARD)
        return {(r["a"], r["b"]) for batch in triage.meetings(made, 0.599, triage.COSINE, triage.JACCARD) for r in batch.to_pylist()}

    grown = found()
    monkeypatch.setattr(triage, "LEVELS", 0)
    fixed = found()
    assert {(k, 40 + k) for k in range(12)} <= grown < fixed and 2 * len(grown) < len(fixed), (len(grown), len(fixed))


def test_texts_by_their_key(spark):
    """the classes of equal texts hold no text; copies, null and empty texts keep their classes."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, "")], "id long, text string")
    found = triage.classes(docs)
    assert found.columns == ["h", "class_id"]
    assert sorted(r.class_id for r in found.collect()) == [1, 2, 4, 6]
    assert "text" not in plan(found).split("Exchange")[0]


def folders(spark, name):
    return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob(f"papyrine/{name}-*")}


def test_spent_rows_are_deleted(spark):
    """the token rows that vectors are made of do not stay beside them."""
    tokens_before, texts_before = folders(spark, "tokens"), folders(spark, "texts")
    catalog.QUERIES["jaccard_documents"](spark, DATA)
    assert folders(spark, "tokens") == tokens_before and folders(spark, "texts") == texts_before


def test_texts_are_ranked_once(spark):
    """when the bound falls, the vectors stay as they are."""
    docs = spark.createDataFrame([(i, [f"w{j}" for j in range(i, i + 6)]) for i in range(12)], "id long, w array<string>")
    before = folders(spark, "ranked")
    got = triage.near_duplicates(docs, F.col("w"), 2.0, 30).collect()
    assert len(got) == 30 and not any(r.above for r in got)
    assert len(folders(spark, "ranked") - before) == 1


def test_lists_are_dealt_to_tasks(spark):
    """behind joins by project the ideas still go to several tasks with the lists of their project; those without a project have no list."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        ideas = spark.range(100).selectExpr("id AS idea", "CASE WHEN id < 96 THEN id % 12 END AS project", "concat('c', id) AS code")
        harvests = spark.range(12).selectExpr("id AS project", "'done' AS status", "id AS n_papers", "id AS n_with_fulltext", "id AS n_gap_sentences", "id AS at", "id")
        checks = spark.range(100).selectExpr("id AS idea", "'adversarial' AS method", "'scooped' AS verdict", "id AS at", "id")
        rounds = spark.range(5).selectExpr("id AS idea", "1 AS round", "0.1 AS drift", "0 AS n_open", "true AS terminated", "'x' AS reason")
        made = rm.caveats_by_idea(ideas, harvests, ideas.select("idea"), checks, rounds, "|").withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {r.idea: r.done for r in made} == {i: "|".join(sorted(f"c{j}" for j in range(i % 12, 96, 12))) if i < 96 else "" for i in range(100)}
    assert len({r.task for r in made}) > 1 and all(len({r.task for r in made if r.project == p}) == 1 for p in range(12))
