"""Search, expansion, harvest, verdict and tournament read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papyrine.operators import discovery, evidence, search as se
from papyrine.plans.catalog import Tables, query
from papyrine.plans.texts import PATHS, paths

# --- several sources -------------------------------------------------------------------------

RECORDS = """x AS (SELECT 'documents' AS source, doc_id * 4 AS rec, md5(text) AS doi, length(text) AS citations FROM documents UNION ALL SELECT 'benchmark', item_id * 4 + 1, md5(text), length(text) FROM benchmark
UNION ALL SELECT 'pages', page_id * 4 + 2, md5(url), length(html) FROM pages), rec AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rec) - 1 AS src_rank FROM x)"""


def sources(t: Tables) -> dict:
    def records(df: DataFrame, own: str, shift: int, key: str, size: str):
        rec = F.col(own) * 4 + shift
        return df.select(rec.alias("rec"), rec.alias("place"), F.md5(key).alias("doi"), F.lit(None).cast("string").alias("title_key"), F.lit(None).cast("string").alias("title"), F.length(size).cast("long").alias("citations"), F.lit(None).cast("int").alias("year"))

    def down():
        raise ConnectionError("no answer")

    def broken():
        """Fails while it is read, at its last record."""
        own = records(t.conversations, "conv_id", 3, "text", "text")
        return own.withColumn("doi", F.when(F.col("rec") < 0, F.col("doi")).otherwise(F.raise_error(F.lit("broke off"))))

    return {
        "documents": lambda: records(t.documents, "doc_id", 0, "text", "text"), "benchmark": lambda: records(t.benchmark, "item_id", 1, "text", "text"),
        "pages": lambda: records(t.pages, "page_id", 2, "url", "html"), "down": down, "broken": broken, "nowhere": None,
    }


@query(f"""WITH {RECORDS} SELECT min(rec) AS work, arg_min(source, (src_rank, source, rec)) AS source, min(src_rank) AS rank, count(*) AS n_records, max(citations) AS citations, count(DISTINCT source) AS n_sources
FROM rec GROUP BY coalesce(doi, 'r' || rec)""")
def multi_source_search(t: Tables) -> DataFrame:
    works, _ = se.search(t.spark, sources(t), "citations")
    return works.select("work", "source", "rank", "n_records", "citations", F.size("also_in").alias("n_sources"))


@query(f"""WITH {RECORDS}, n AS (SELECT source, count(*) AS n_records FROM x GROUP BY source), v(source, answered, error) AS (VALUES ('documents', true, NULL), ('benchmark', true, NULL), ('pages', true, NULL),
('down', false, 'ConnectionError: no answer'), ('broken', false, 'breaks'), ('nowhere', false, 'LookupError: unknown source')) SELECT v.*, coalesce(n_records, 0) AS n_records FROM v LEFT JOIN n USING (source)""")
def search_attempts(t: Tables) -> DataFrame:
    tried = se.asked(t.spark, sources(t))[1]
    return tried.withColumn("error", F.when(F.col("source") == "broken", F.when(F.col("error").contains("broke off"), "breaks")).otherwise(F.col("error")))


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS src_rank FROM documents")
def in_source_rank(t: Tables) -> DataFrame:
    return se.in_source_rank(t.documents.select("source", F.col("doc_id").alias("rec"), F.col("n_chars").alias("place"))).select("source", F.col("rec").alias("doc_id"), "src_rank")


# --- vocabulary ------------------------------------------------------------------------------

PLAIN = "regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')"
BACK = "array_to_string(list_reverse(string_split({}, ' ')), ' ')"
HOLDS = f"(contains(' ' || {PLAIN.format('label')} || ' ', ' ' || {PLAIN.format('asked')} || ' ') OR contains(' ' || {PLAIN.format('label')} || ' ', ' ' || {PLAIN.format(BACK.format('asked'))} || ' '))"


@query(f"""WITH n AS (SELECT DISTINCT p_name AS label FROM part), e AS (SELECT DISTINCT p_name AS ui, p_brand || ' ' || p_name AS entry FROM part), s AS (SELECT p_brand AS term, min(p_name) AS name FROM part GROUP BY 1),
q AS (SELECT {BACK.format('label')} AS term FROM n UNION SELECT replace(label, ' ', '') FROM n UNION SELECT upper(entry) FROM e UNION SELECT p_brand FROM part),
d AS (SELECT term, ui, 'entry' AS via FROM q JOIN e ON lower(term) = lower(entry) UNION ALL SELECT term, label, 'label' FROM (SELECT term, term AS asked FROM q) JOIN n ON {HOLDS}),
r AS (SELECT term FROM q WHERE term NOT IN (SELECT term FROM d)), p AS (SELECT term, label AS ui, 'normalised' AS via FROM r JOIN n ON regexp_replace(lower(term), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(label), '[^a-z0-9]+', '', 'g')),
y AS (SELECT term, label AS ui, 'synonym' AS via FROM (SELECT r.term, name AS asked FROM r JOIN s USING (term) WHERE r.term NOT IN (SELECT term FROM p)) JOIN n ON {HOLDS})
SELECT term, ui, min(via) AS via FROM (SELECT * FROM d UNION ALL SELECT * FROM p UNION ALL SELECT * FROM y) GROUP BY term, ui""")
def descriptor_lookup(t: Tables) -> DataFrame:
    labels = t.part.select(F.col("p_name").alias("ui"), F.col("p_name").alias("label")).distinct()
    entries = t.part.select(F.col("p_name").alias("ui"), F.concat_ws(" ", "p_brand", "p_name").alias("entry")).distinct()
    names = t.part.groupBy(F.col("p_brand").alias("term")).agg(F.min("p_name").alias("name"))
    terms = labels.select(F.array_join(F.reverse(F.split("label", " ")), " ").alias("term")).union(labels.select(F.replace("label", F.lit(" "), F.lit("")))).union(entries.select(F.upper("entry"))).union(t.part.select("p_brand")).distinct()
    return se.lookup(terms, entries, labels, names).select("term", "ui", "via")


NODES = """nodes AS (SELECT 'n' || n_nationkey AS ui, n_name AS label FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region), terms AS (SELECT DISTINCT label AS term FROM nodes UNION SELECT 'no such thing'),
found AS (SELECT term, ui, label, row_number() OVER (PARTITION BY term ORDER BY term <> label, ui) AS place FROM terms JOIN nodes ON left(term, 1) = left(label, 1) WHERE term IN (SELECT label FROM nodes))"""


def expanded(t: Tables) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("ui")
    nodes = t.nation.select(name("n", "n_nationkey"), F.col("n_name").alias("label")).union(t.region.select(name("r", "r_regionkey"), "r_name"))
    known = nodes.select(F.col("label").alias("term")).distinct()
    terms = known.union(t.spark.createDataFrame([("no such thing",)], "term string"))
    first = lambda c: F.substring(c, 1, 1)
    found = known.join(nodes, first("term") == first("label")).withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy(F.col("term") != F.col("label"), "ui")))
    up = t.nation.select(name("n", "n_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("relative"))
    near = up.select("ui", "relative", F.lit("broader").alias("relation")).union(up.select("relative", "ui", F.lit("narrower")))
    near = near.join(nodes.toDF("relative", "label"), "relative").withColumn("place", F.row_number().over(Window.partitionBy("ui").orderBy("relative")))
    return se.expansion(terms, found, near.select("ui", "relative", "label", "relation", "place"), 6)


@query(f"""WITH {NODES}, u AS (SELECT 'n' || n_nationkey AS ui, 'r' || n_regionkey AS relative, 'broader' AS relation FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'narrower' FROM nation),
near AS (SELECT u.ui, relative, relation, row_number() OVER (PARTITION BY u.ui ORDER BY relative) AS place FROM u), h AS (SELECT term, ui AS head FROM found WHERE place = 1),
a AS (SELECT term, head, relative AS ui, relation, 0 AS kind, place FROM h JOIN near ON near.ui = head UNION ALL SELECT f.term, head, f.ui, 'label_match', 1, place FROM found f JOIN h USING (term) WHERE place > 1),
o AS (SELECT *, row_number() OVER (PARTITION BY term, ui ORDER BY kind, place, relation) AS k FROM a WHERE ui <> head), z AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY kind, place, ui) AS n FROM o WHERE k = 1) SELECT term, ui, relation, n AS rank FROM z WHERE n <= 5""")
def concept_expansion(t: Tables) -> DataFrame:
    return expanded(t)[1].select("term", "ui", "relation", "rank")


@query("""WITH n AS (SELECT n_name AS label FROM nation UNION SELECT r_name FROM region), t AS (SELECT DISTINCT c_mktsegment AS term FROM customer UNION SELECT label FROM n), x AS (SELECT term, term IN (SELECT label FROM n) AS expanded FROM t)
SELECT bool_or(NOT expanded) AS degraded, count(*) FILTER (WHERE NOT expanded) AS n, coalesce(string_agg(term, '|' ORDER BY term) FILTER (WHERE NOT expanded), '') AS unexpanded FROM x""")
def expansion_degraded(t: Tables) -> DataFrame:
    """Segments of customers are no names of nations or regions."""
    from pyspark.sql import Window

    nodes = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("ui"), F.col("n_name").alias("label")).union(t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")), "r_name"))
    terms = t.customer.select(F.col("c_mktsegment").alias("term")).union(nodes.select("label")).distinct()
    found = terms.join(nodes, F.col("term") == F.col("label")).withColumn("place", F.row_number().over(Window.partitionBy("term").orderBy("ui")))
    none = nodes.select("ui", F.col("ui").alias("relative"), "label", F.lit("broader").alias("relation"), F.lit(1).alias("place")).limit(0)
    return se.degraded(se.expansion(terms, found, none)[0]).withColumn("unexpanded", F.array_join("unexpanded", "|"))


@query(f"""WITH {PATHS} SELECT p.ui, string_agg(DISTINCT path, '|' ORDER BY path) AS paths, coalesce(min(n_name), '') AS broader, min(r_name) AS note
FROM p LEFT JOIN supplier ON p.ui = 's' || s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON p.ui = 'r' || r_regionkey GROUP BY p.ui""")
def vocabulary_metadata(t: Tables) -> DataFrame:
    own = paths(t)
    broader = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("ui"), F.col("n_name").alias("label"))
    notes = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("ui"), F.col("r_name").alias("note"))
    return se.described(own.select("ui").distinct(), own, broader, notes).select("ui", F.array_join("paths", "|").alias("paths"), F.array_join("broader", "|").alias("broader"), "note")


# --- works and citations ---------------------------------------------------------------------

WORKS = "wk AS (SELECT p_partkey AS work, 'D/' || p_partkey AS doi, 'W' || p_partkey AS id, nullif(regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), '') AS title_key, p_size AS citations FROM part)"


@query(f"""WITH {WORKS}, q AS (SELECT lower(doi) AS q FROM wk UNION SELECT id FROM wk UNION SELECT upper(p_name) FROM part UNION SELECT 'nothing of the kind'), k AS (SELECT title_key, arg_max(work, (citations, -work)) AS w FROM wk WHERE title_key IS NOT NULL GROUP BY 1)
SELECT q, coalesce(a.work, b.work, k.w) AS work FROM q LEFT JOIN wk a ON lower(a.doi) = lower(q) LEFT JOIN wk b ON lower(b.id) = lower(q) LEFT JOIN k ON k.title_key = regexp_replace(lower(q), '[^a-z0-9]+', '', 'g')""")
def work_resolution(t: Tables) -> DataFrame:
    from papyrine.functions.text import squashed

    key = F.col("p_partkey").cast("string")
    works = t.part.select(F.col("p_partkey").alias("work"), F.concat(F.lit("D/"), key).alias("doi"), F.concat(F.lit("W"), key).alias("id"), squashed(F.col("p_name"), None).alias("title_key"), F.col("p_size").alias("citations"), "p_name")
    asked = works.select(F.lower("doi").alias("q")).union(works.select("id")).union(works.select(F.upper("p_name"))).union(t.spark.createDataFrame([("nothing of the kind",)], "q string"))
    return se.resolved(asked, works)


@query("WITH l AS (SELECT l_partkey AS a, l_suppkey AS b, sum(l_quantity) AS score FROM lineitem GROUP BY ALL), z AS (SELECT a AS seed, b AS work, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM l WHERE a <> b) SELECT * FROM z WHERE rank <= 3")
def related_works(t: Tables) -> DataFrame:
    links = t.lineitem.groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum("l_quantity").alias("score"))
    return se.related(links, t.part.select(F.col("p_partkey").alias("seed")), 3)


TOPIC = "list_distinct(regexp_extract_all(lower(p_name), '[a-z][a-z0-9-]{2,}'))"
OVERLAP = "CASE WHEN len({a}) > 0 THEN round(len(list_intersect({a}, {b})) / len({a}), 3) ELSE 0.0 END"


@query(f"""WITH n AS (SELECT l_partkey AS work, count(*) * 20 AS citations FROM lineitem GROUP BY 1), w AS (SELECT p_partkey AS work, citations, 1980 + p_size AS year, {TOPIC} AS k FROM part LEFT JOIN n ON n.work = p_partkey),
e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey <> l_suppkey),
b AS (SELECT s.work AS seed, 'backward' AS way, d.work, greatest(round(least(coalesce(d.citations, 0) / 1000, 1.0) * CASE WHEN s.year - d.year >= 5 THEN 1.0 ELSE 0.6 END, 3), round(least(coalesce(d.citations, 0) / 300, 1.0) * CASE WHEN s.year - d.year > 0 AND s.year - d.year <= 5 THEN 1.0 ELSE 0.5 END, 3), {OVERLAP.format(a='s.k', b='d.k')}) AS score, d.citations
FROM e JOIN w s ON s.work = src JOIN w d ON d.work = dst), f AS (SELECT s.work AS seed, 'forward' AS way, d.work, {OVERLAP.format(a='s.k', b='d.k')} AS score, d.citations FROM e JOIN w s ON s.work = dst JOIN w d ON d.work = src),
z AS (SELECT *, row_number() OVER (PARTITION BY seed, way ORDER BY score DESC, CASE WHEN way = 'forward' THEN coalesce(citations, 0) ELSE 0 END DESC, work) AS rank FROM (SELECT * FROM b UNION ALL SELECT * FROM f))
SELECT seed, way, work, score, rank, coalesce(citations, 0) >= 1000 AS stops FROM z WHERE rank <= 6""")
def citation_neighbours(t: Tables) -> DataFrame:
    cited = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg((F.count("*") * 20).alias("citations"))
    works = t.part.join(cited, "p_partkey", "left").select(F.col("p_partkey").alias("work"), "citations", (F.col("p_size") + 1980).alias("year"), se.topic_tokens(F.col("p_name")).alias("tokens"))
    return se.neighbours(t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), works)


# --- harvest, verdicts, caveats --------------------------------------------------------------

HARVEST = """h AS (SELECT d.doc_id AS paper, d.source, d.lang <> 'en' AS has_id, l.doc_id IS NOT NULL AS looked, CASE WHEN b.text IS NOT NULL AND trim(b.text) <> '' THEN 'discussion' WHEN trim(d.text) <> '' THEN 'abstract' END AS found_in
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id LEFT JOIN benchmark b ON b.item_id = l.doc_id)"""


def papers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents as papers; labels say which were looked up, benchmark what was found."""
    own = t.documents.select(F.col("doc_id").alias("paper"), "source", (F.col("lang") != "en").alias("has_id"), F.col("text").alias("abstract"))
    cache = t.labels.select(F.col("doc_id").alias("paper")).join(t.benchmark.select(F.col("item_id").alias("paper"), F.col("text").alias("section")), "paper", "left")
    return own, cache


@query(f"WITH {HARVEST} SELECT paper, looked, found_in FROM h")
def harvest_sections(t: Tables) -> DataFrame:
    return evidence.harvested(*papers(t)).select("paper", "looked", "found_in")


@query(f"""WITH {HARVEST} SELECT source, count(*) AS n_papers, count(*) FILTER (WHERE found_in = 'discussion') AS n_with_fulltext, count(*) FILTER (WHERE looked AND found_in IS DISTINCT FROM 'discussion') AS n_no_section,
count(*) FILTER (WHERE NOT has_id AND NOT looked) AS n_without_identifier, count(*) FILTER (WHERE found_in = 'abstract') AS n_from_abstract FROM h GROUP BY source""")
def harvest_counters(t: Tables) -> DataFrame:
    return evidence.harvest_counts(evidence.harvested(*papers(t)), "source")


@query("SELECT doc_id AS paper FROM documents WHERE lang <> 'en' AND doc_id NOT IN (SELECT l.doc_id FROM labels l JOIN benchmark ON item_id = l.doc_id)")
def harvest_again(t: Tables) -> DataFrame:
    return evidence.to_fetch(*papers(t), again=True).select("paper")


WORDS = ("ALREADY DONE", "PURSUED SINCE", "STILL OPEN", "TERM TOO RARE", "NO TERMS", "SINGLE GROUP", "CHECK FAILED")
SAID = f"""s AS (SELECT event_id, [{', '.join(f"'{w}'" for w in WORDS)}, NULL][event_id % 8 + 1] AS verdict,
CASE WHEN value < 30 THEN 'ADJACENT' WHEN value < 60 THEN 'NEVER MEET' END AS zone, CASE WHEN user_id > 9 THEN 'user ' || user_id END AS why, user_id % 5 AS slots, CASE WHEN value > 90 THEN value END AS co FROM events)"""


@query(f"""WITH {SAID} SELECT event_id, CASE WHEN verdict IN ('ALREADY DONE', 'PURSUED SINCE') THEN 'scooped' WHEN verdict = 'STILL OPEN' AND zone = 'ADJACENT' THEN 'adjacent' WHEN verdict = 'STILL OPEN' THEN 'no_prior_art' END AS stored,
nullif(concat_ws(' | ', CASE WHEN verdict IN ('TERM TOO RARE', 'NO TERMS', 'SINGLE GROUP', 'CHECK FAILED') THEN 'no ruling: ' || coalesce(why, verdict) END, CASE WHEN slots >= 3 THEN 'three or more slots: a weak not-done' END,
CASE WHEN zone = 'NEVER MEET' THEN 'concepts never met before the cutoff' END, CASE WHEN zone = 'ADJACENT' AND verdict = 'STILL OPEN' THEN 'adjacent is no praise of the question' END,
CASE WHEN co IS NOT NULL THEN 'co-mentions of the open subset only' END), '') AS limits FROM s""")
def verdict_limits(t: Tables) -> DataFrame:
    value = F.col("value")
    verdict = F.get(F.array(*map(F.lit, WORDS)), (F.col("event_id") % 8).cast("int"))
    zone = F.when(value < 30, "ADJACENT").when(value < 60, "NEVER MEET")
    why = F.when(F.col("user_id") > 9, F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return t.events.select("event_id", evidence.novelty(verdict, zone).alias("stored"), evidence.limits(verdict, zone, why, F.col("user_id") % 5, F.when(value > 90, value)).alias("limits"))


@query("""WITH p AS (SELECT DISTINCT user_id AS project FROM events), h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'purchase'),
g AS (SELECT DISTINCT user_id AS project, floor(value) AS idea FROM events WHERE event_type = 'view'), c AS (SELECT user_id AS project, floor(value) AS idea, CASE WHEN event_id % 3 = 0 THEN 'scooped' ELSE 'open' END AS verdict, row_number() OVER (PARTITION BY user_id, floor(value) ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'click'),
u AS (SELECT g.project, count(*) AS n_graded, count(*) FILTER (WHERE c.idea IS NULL) AS n_unverified FROM g LEFT JOIN c ON c.project = g.project AND c.idea = g.idea AND c.n = 1 GROUP BY 1), s AS (SELECT project, count(*) AS n_done, sum(idea) AS done FROM c WHERE n = 1 AND verdict = 'scooped' GROUP BY 1),
r AS (SELECT user_id AS project, max(event_id) AS n_rounds, arg_max(value, event_id) AS n_open FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT p.project, h.event_id AS n_papers, floor(h.value) AS n_with_fulltext, h.event_id - floor(h.value) AS n_silent, coalesce(n_graded, 0) AS n_graded, coalesce(n_unverified, 0) AS n_unverified, coalesce(n_done, 0) AS n_done, coalesce(done, 0) AS done, coalesce(n_rounds, 0) AS n_rounds, n_open
FROM p LEFT JOIN h ON h.user_id = p.project AND h.n = 1 LEFT JOIN u USING (project) LEFT JOIN s USING (project) LEFT JOIN r USING (project)""")
def run_caveats(t: Tables) -> DataFrame:
    ev = t.events.select(F.col("user_id").alias("project"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.floor("value").cast("double").alias("idea"), "event_type", "value")
    of = lambda kind: ev.where(F.col("event_type") == kind)
    reads = of("purchase").select("project", "at", "id", F.col("id").alias("n_papers"), F.col("idea").alias("n_with_fulltext"))
    checks = of("click").select("project", "idea", F.when(F.col("id") % 3 == 0, "scooped").otherwise("open").alias("verdict"), "at", "id")
    rounds = of("error").select("project", F.col("id").alias("round_no"), F.col("value").alias("open"))
    out = evidence.caveats(ev.select("project").distinct(), reads, of("view").select("project", "idea"), checks, rounds)
    return out.withColumn("done", F.aggregate("done", F.lit(0.0), lambda a, x: a + x))


@query("WITH z AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey AS idea, o_orderstatus AS tier, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS missing, o_orderkey AS route FROM z WHERE n = 1")
def latest_acquisition(t: Tables) -> DataFrame:
    graded = t.orders.select(F.col("o_custkey").alias("idea"), F.col("o_orderstatus").alias("tier"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("missing"), F.col("o_orderkey").alias("route"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    return evidence.acquisition(graded).select("idea", "tier", F.array_join("missing", "|").alias("missing"), "route")


@query("""WITH f AS (SELECT lower(o_orderpriority) AS k, o_custkey AS d, min(o_orderdate) AS first_at FROM orders GROUP BY ALL) SELECT o_orderstatus AS run, count(*) AS n_queries, count(*) FILTER (WHERE first_at < o_orderdate) AS n_repeated,
round(count(*) FILTER (WHERE first_at < o_orderdate) / count(*), 4) AS query_repeat_rate FROM orders JOIN f ON k = lower(o_orderpriority) AND d = o_custkey GROUP BY 1""")
def query_repeat_rate(t: Tables) -> DataFrame:
    return evidence.query_repeat_rate(t.orders.select(F.col("o_orderstatus").alias("run"), F.concat(F.lit(" "), "o_orderpriority", F.lit("  ")).alias("text"), F.col("o_custkey").alias("domain"), F.col("o_orderdate").alias("at")))


@query("SELECT p_partkey, CASE WHEN p_name ILIKE 'cold%' OR p_name ILIKE '%anvil' THEN 2 WHEN p_name ILIKE '%widget%' THEN 1 ELSE 0 END AS tier FROM part")
def venue_tiers(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", evidence.venue_tier(F.col("p_name"), ["Cold%", "%anvil"], ["%widget%"]).alias("tier"))


# --- the gate of the bridge experiment -------------------------------------------------------


@query("""WITH r AS (SELECT p_partkey AS item, p_size % 4 = 0 AS silent, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part), s AS (SELECT * FROM r WHERE place <= 160), t AS (SELECT item, place FROM s WHERE silent ORDER BY place LIMIT 20)
SELECT item, place, CAST(CASE WHEN (SELECT count(*) FROM t) = 20 THEN (SELECT max(place) FROM t) ELSE (SELECT max(place) FROM s) END AS BIGINT) AS n_scanned FROM t""")
def silent_top(t: Tables) -> DataFrame:
    first = t.part.orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(160)
    from pyspark.sql import Window

    ranked = first.select(F.col("p_partkey").alias("item"), (F.col("p_size") % 4 == 0).alias("silent"), F.row_number().over(Window.orderBy(F.col("p_retailprice").desc(), "p_partkey")).alias("place"))
    return discovery.silent_first(ranked, 20)


@query("""WITH x AS (SELECT p_size < 10 AS top, p_retailprice > 1000 AS hit, p_size FROM part), r AS (SELECT avg(CAST(hit AS INT)) FILTER (WHERE top) AS a, avg(CAST(hit AS INT)) FILTER (WHERE NOT top) AS b, count(*) FILTER (WHERE top) AS n_top, count(*) FILTER (WHERE NOT top) AS n_control, round(avg(p_size) FILTER (WHERE top), 2) AS mean_ltc_top, round(avg(p_size) FILTER (WHERE NOT top), 2) AS mean_ltc_control FROM x)
SELECT a AS top_hit_rate, b AS control_hit_rate, n_top, n_control, mean_ltc_top, mean_ltc_control, CASE WHEN a > 0 AND b > 0 THEN a / b END AS ratio, CASE WHEN b > 0.5 OR NOT coalesce(a > 0 AND b > 0, false) THEN 'VOID' WHEN a / b >= 2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r""")
def bridge_gate(t: Tables) -> DataFrame:
    return discovery.gate(t.part.select(F.when(F.col("p_size") < 10, "top").otherwise("control").alias("kind"), (F.col("p_retailprice") > 1000).alias("hit"), F.col("p_size").alias("ltc")))


# --- anchors and fields ----------------------------------------------------------------------


@query("""WITH o AS (SELECT 'local' AS origin, 'x' || s_suppkey AS k, s_name AS title, 0 AS new, s_suppkey AS seq FROM supplier), n AS (SELECT 'local', CASE WHEN c_custkey % 2 = 0 THEN 'x' || (c_custkey % 200) ELSE 't' || trim(c_mktsegment) END, trim(c_mktsegment), 1, c_custkey FROM customer),
z AS (SELECT *, row_number() OVER (PARTITION BY origin, k ORDER BY new DESC, seq DESC) AS r FROM (SELECT * FROM o UNION ALL SELECT * FROM n)) SELECT origin, title, seq FROM z WHERE r = 1""")
def anchor_upsert(t: Tables) -> DataFrame:
    none = F.array().cast("array<string>")
    old = t.supplier.select(F.col("s_suppkey").cast("string").alias("external_id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("origin"), none.alias("term_groups"), F.lit("1990").alias("cutoff"), F.col("s_suppkey").alias("seq"))
    new = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") % 200).cast("string")).alias("external_id"), F.concat(F.lit(" "), "c_mktsegment").alias("title"), F.lit("").alias("origin"), none.alias("term_groups"), F.lit("soon").alias("cutoff"), F.col("c_custkey").alias("seq"))
    return evidence.keyed(evidence.guarded(old), evidence.guarded(new), "seq").select("origin", "title", "seq")


@query("""WITH v AS (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT c_custkey AS idea, o_orderstatus AS last_verdict FROM customer LEFT JOIN v ON o_custkey = c_custkey AND n = 1 WHERE c_acctbal >= 0 AND (o_orderstatus IS NULL OR o_orderstatus <> 'scooped')""")
def live_ideas(t: Tables) -> DataFrame:
    ideas = t.customer.select(F.col("c_custkey").alias("idea"), F.when(F.col("c_acctbal") < 0, F.lit(1)).alias("merged_into"))
    verdicts = t.orders.select(F.col("o_custkey").alias("idea"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    return evidence.live(ideas, verdicts).select("idea", "last_verdict")


@query("SELECT o_custkey AS a, o_orderkey AS b, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS verdict, o_totalprice AS score FROM orders ORDER BY o_orderstatus <> 'O', o_totalprice DESC, 1, 2 LIMIT 50")
def undecided_pairs(t: Tables) -> DataFrame:
    return evidence.undecided_first(t.orders.select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).alias("verdict"), F.col("o_totalprice").alias("score"))).limit(50)


@query("SELECT user_id AS run, count(*) FILTER (WHERE event_type = 'error') AS n_open FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') > 0 ORDER BY max(ts) DESC, user_id DESC LIMIT 1")
def pending_run(t: Tables) -> DataFrame:
    return evidence.pending(t.events.select(F.col("user_id").alias("run"), F.col("ts").alias("at"), (F.col("event_type") != "error").alias("answered"))).select("run", "n_open")


@query("SELECT user_id AS project, count(*) FILTER (WHERE event_type = 'error') AS n_parked, count(*) FILTER (WHERE event_type = 'purchase') AS n_done, count(*) AS n_stages FROM events GROUP BY 1")
def parked_totals(t: Tables) -> DataFrame:
    return evidence.parked(t.events.select(F.col("user_id").alias("project"), F.when(F.col("event_type") == "error", "parked").when(F.col("event_type") == "purchase", "done").otherwise("open").alias("state")))


@query("""WITH g AS (SELECT l_orderkey % 50 AS tournament, l_suppkey AS l, l_partkey AS r, CASE WHEN l_quantity < 20 THEN 'l' WHEN l_quantity < 40 THEN 'r' END AS winner FROM lineitem),
x AS (SELECT tournament, l AS id, winner = 'l' AS won, winner IS NULL AS open FROM g UNION ALL SELECT tournament, r, winner = 'r', winner IS NULL FROM g), k AS (SELECT tournament, id, count(*) AS n_games, count(*) FILTER (WHERE won) AS n_won, count(*) FILTER (WHERE open) AS n_open FROM x GROUP BY ALL),
e AS (SELECT s_nationkey AS tournament, s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'anchor' ELSE 'idea' END AS side, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier)
SELECT e.*, coalesce(n_games, 0) AS n_games, coalesce(n_won, 0) AS n_won, coalesce(n_open, 0) AS n_open FROM e LEFT JOIN k USING (tournament, id)""")
def tournament_model(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    games = t.lineitem.select((F.col("l_orderkey") % 50).alias("tournament"), F.col("l_suppkey").alias("l"), F.col("l_partkey").alias("r"), F.when(q < 20, "l").when(q < 40, "r").alias("winner"))
    entries = t.supplier.select(F.col("s_nationkey").cast("long").alias("tournament"), F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 == 0, "anchor").otherwise("direction").alias("kind"), F.col("s_acctbal").alias("elo"))
    return evidence.tournament(entries, games).drop("elo")
