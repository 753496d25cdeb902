"""Listings, debates, caveats by idea, rounds, ingest counters, dialects and concepts, over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papyrine.functions import text as tx
from papyrine.operators import readmodels as rm, vocabulary as voc
from papyrine.plans.catalog import Tables, query
from papyrine.plans.texts import PATHS, paths

# --- listings --------------------------------------------------------------------------------


def checks(t: Tables) -> DataFrame:
    """Orders as checks of customers."""
    method = F.when(F.col("o_orderpriority").startswith("1"), "mechanical").otherwise("adversarial")
    return t.orders.select(
        F.col("o_custkey").alias("idea"), (F.col("o_custkey") % 50).alias("project"), F.col("o_orderpriority").alias("run"), method.alias("method"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("verdict"),
        F.col("o_orderpriority").alias("limits"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"),
    )


@query("""WITH n AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey AS idea, c_nationkey AS project, o_orderpriority AS run, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS verdict FROM customer LEFT JOIN n ON o_custkey = c_custkey
WHERE c_mktsegment = 'MACHINERY' ORDER BY c_acctbal DESC, c_custkey LIMIT 200""")
def listed_ideas(t: Tables) -> DataFrame:
    ideas = t.customer.select(F.col("c_custkey").alias("idea"), F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("created_at"))
    return rm.listed_ideas(ideas, checks(t).drop("project"), 200, status="MACHINERY", project=None).select("idea", "project", "run", "verdict")


@query("""WITH r AS (SELECT c_custkey AS run, c_nationkey AS project, c_mktsegment AS stage, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS started_at FROM customer), q AS (SELECT o_custkey AS run, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT user_id AS run, count(*) AS n FROM events GROUP BY 1)
SELECT r.*, coalesce(q.n, 0) AS n_queries, coalesce(k.n, 0) AS n_checked, row_number() OVER (PARTITION BY project ORDER BY started_at DESC NULLS LAST, run DESC) AS rank FROM r LEFT JOIN q USING (run) LEFT JOIN k USING (run) QUALIFY rank <= 10""")
def listed_runs(t: Tables) -> DataFrame:
    runs = t.customer.select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("stage"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("started_at"))
    return rm.listed_runs(runs, t.orders.select(F.col("o_custkey").alias("run")), t.events.select(F.col("user_id").alias("run")), 10)


@query("""WITH m AS (SELECT event_type AS metric, value, ts, user_id AS run, c_nationkey AS project, c_mktsegment AS stage FROM events LEFT JOIN customer ON c_custkey = user_id)
SELECT metric, value, run, project, stage, value - lead(value) OVER w AS change, row_number() OVER w AS rank FROM m WINDOW w AS (PARTITION BY project, metric ORDER BY ts DESC, run DESC) QUALIFY rank <= 10""")
def metric_history(t: Tables) -> DataFrame:
    metrics = t.events.select(F.col("event_type").alias("metric"), "value", F.col("ts").alias("at"), F.col("user_id").alias("run"))
    runs = t.customer.select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("stage"))
    return rm.metric_history(metrics, runs, 10).drop("at")


@query("""WITH n AS (SELECT * FROM orders WHERE o_orderpriority NOT LIKE '1%' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey % 50 AS project, CASE o_orderstatus WHEN 'P' THEN 'no_ruling' ELSE o_orderstatus END AS verdict, count(*) AS n FROM n GROUP BY ALL""")
def verdict_counts(t: Tables) -> DataFrame:
    return rm.verdict_counts(checks(t))


# --- debates and rounds ----------------------------------------------------------------------


@query("""WITH r AS (SELECT user_id AS idea, event_id AS round, CASE event_type WHEN 'view' THEN ' v' || event_id WHEN 'click' THEN ' ' END AS revised, value / 100 AS drift, event_type = 'purchase' AS terminated, CASE event_type WHEN 'purchase' THEN 'sold' END AS reason FROM events),
p AS (SELECT idea, count(*) AS n, arg_max(trim(revised), round) FILTER (WHERE trim(revised) <> '') AS revised, arg_max(terminated, round) AS terminated, arg_max({'x': reason}, round).x AS reason, arg_max(drift, round) AS drift FROM r GROUP BY idea),
o AS (SELECT o_custkey AS idea, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '2%') AS standing, count(*) FILTER (WHERE o_orderstatus = 'O') AS open FROM orders GROUP BY 1)
SELECT c_custkey AS idea, c_name AS original, coalesce(revised, c_name) AS current, coalesce(p.n, 0) AS rounds_done, coalesce(p.n, 0) + 1 AS next_round, coalesce(terminated, false) AS terminated, reason, coalesce(drift, 0.0) AS drift, coalesce(o.n, 0) AS n_objections, coalesce(standing, 0) AS n_standing, coalesce(open, 0) AS n_open, coalesce(p.n, 0) AS n_trajectory
FROM customer LEFT JOIN p ON p.idea = c_custkey LEFT JOIN o ON o.idea = c_custkey""")
def debate_states(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    rounds = t.events.select(F.col("user_id").alias("idea"), F.col("event_id").alias("round"), F.when(kind == "view", F.concat(F.lit(" v"), F.col("event_id").cast("string"))).when(kind == "click", " ").alias("revised"), (F.col("value") / 100).alias("drift"), F.col("value").alias("distance"), (kind == "purchase").alias("terminated"), F.when(kind == "purchase", "sold").alias("reason"))
    objections = t.orders.select(F.col("o_custkey").alias("idea"), F.lit(1).alias("round"), F.lit("major").alias("severity"), F.when(F.col("o_orderpriority").startswith("2"), "strong").alias("support"), F.when(F.col("o_orderstatus") == "O", "unresolved").otherwise("resolved_by_evidence").alias("status"))
    ideas = t.customer.select(F.col("c_custkey").alias("idea"), F.lit(" ").alias("statement"), F.col("c_name").alias("title"))
    return rm.debate_state(ideas, rounds, objections).withColumn("n_trajectory", F.coalesce(F.size("trajectory"), F.lit(0)).cast("long")).withColumn("n_trajectory", F.greatest("n_trajectory", F.lit(0))).drop("trajectory")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 6 AS drift, l_linenumber * 2 AS round, CAST(l_quantity AS BIGINT) % 3 AS standing, CAST(l_quantity AS BIGINT) % 5 AS open, CASE l_returnflag WHEN 'A' THEN ' enough ' WHEN 'R' THEN ' ' END AS said FROM lineitem),
w AS (SELECT *, CASE WHEN drift > 0.5 THEN 'drift' WHEN standing = 0 THEN CASE WHEN open > 0 THEN 'nothing cited is open, uncited remain' ELSE 'nothing cited is open' END WHEN round >= 10 THEN 'round cap' ELSE nullif(trim(said), '') END AS why FROM s) SELECT l_orderkey, l_linenumber, why, why IS NOT NULL AS terminated FROM w""")
def debate_decisions(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("long")
    state = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 6).alias("drift"), (F.col("l_linenumber") * 2).alias("round"), (q % 3).alias("n_standing"), (q % 5).alias("n_open"), F.when(F.col("l_returnflag") == "A", " enough ").when(F.col("l_returnflag") == "R", " ").alias("said"))
    return rm.decided(state).select("l_orderkey", "l_linenumber", "why", "terminated")


ROUNDS = "rd AS (SELECT user_id AS \"check\", event_id AS round, CASE WHEN value < 90 THEN CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE ' ' || event_type END END AS angle, CASE WHEN value > 5 THEN 'q' ELSE ' ' END AS query, CASE WHEN value < 60 THEN 0 WHEN value < 95 THEN 3 END AS n_hits, CASE WHEN user_id % 4 > 0 THEN 'plain' WHEN value < 50 THEN 'other' END AS vocabulary FROM events)"


def rounds(t: Tables) -> DataFrame:
    v, kind = F.col("value"), F.col("event_type")
    angle = F.when(v < 90, F.when(F.col("event_id") % 2 == 0, F.upper(kind)).otherwise(F.concat(F.lit(" "), kind)))
    return t.events.select(F.col("user_id").alias("check"), F.col("event_id").alias("round"), angle.alias("angle"), F.when(v > 5, "q").otherwise(" ").alias("query"), F.when(v < 60, 0).when(v < 95, 3).alias("n_hits"), F.when(F.col("user_id") % 4 > 0, "plain").when(v < 50, "other").alias("vocabulary"))


@query(f"""WITH {ROUNDS}, f AS (SELECT "check", lower(trim(angle)) AS a, min(round) AS first FROM rd WHERE trim(query) <> '' AND trim(angle) <> '' GROUP BY ALL)
SELECT rd."check", round, CASE WHEN trim(query) = '' THEN 'empty query' WHEN round > first THEN 'angle repeats an earlier round' END AS error FROM rd LEFT JOIN f ON f."check" = rd."check" AND f.a = lower(trim(angle))""")
def vetted_rounds(t: Tables) -> DataFrame:
    return rm.vetted_rounds(rounds(t)).select("check", "round", "error")


@query(f"""WITH {ROUNDS}, u AS (SELECT * REPLACE (angle || round AS angle) FROM rd WHERE round % 3 > 0), c AS (SELECT DISTINCT user_id AS "check", ['scooped', 'incremental', 'adjacent', 'no_prior_art', 'done', NULL, ' No_Prior_Art'][1 + user_id % 7] AS verdict, user_id % 3 AS n_papers, CASE WHEN user_id % 5 > 0 THEN 'two sources' END AS limits FROM events),
e AS (SELECT "check", g, count(*) FILTER (WHERE n_hits = 0) AS k FROM (SELECT *, sum(CASE WHEN n_hits > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY "check" ORDER BY round) AS g FROM u WHERE n_hits IS NOT NULL) GROUP BY ALL), l AS (SELECT "check", max(k) AS longest FROM e GROUP BY 1),
d AS (SELECT DISTINCT "check" FROM (SELECT "check" FROM u WHERE angle IS NOT NULL GROUP BY "check", lower(trim(angle)) HAVING count(*) > 1)), w AS (SELECT "check", count(DISTINCT vocabulary) AS words FROM u GROUP BY 1)
SELECT c."check", coalesce(longest, 0) AS longest_empty_run, CASE WHEN lower(trim(verdict)) NOT IN ('scooped', 'incremental', 'adjacent', 'no_prior_art') THEN 'unknown verdict' WHEN d."check" IS NOT NULL THEN 'angles repeat' WHEN lower(trim(verdict)) IN ('scooped', 'incremental') AND n_papers = 0 THEN 'prior work needs a paper'
WHEN lower(trim(verdict)) = 'no_prior_art' AND limits IS NULL THEN 'a negative needs its bounds' WHEN lower(trim(verdict)) = 'no_prior_art' AND coalesce(longest, 0) >= 3 AND coalesce(words, 0) < 2 THEN 'one vocabulary found nothing' END AS why
FROM c LEFT JOIN l USING ("check") LEFT JOIN d ON d."check" = c."check" LEFT JOIN w ON w."check" = c."check" """)
def refused_checks(t: Tables) -> DataFrame:
    own = rounds(t).where("round % 3 > 0").withColumn("angle", F.concat("angle", F.col("round").cast("string")))
    user = F.col("user_id")
    said = F.get(F.array(*[F.lit(x) for x in ("scooped", "incremental", "adjacent", "no_prior_art", "done", None, " No_Prior_Art")]), (user % 7).cast("int"))
    all_checks = t.events.select(user.alias("check"), said.alias("verdict"), (user % 3).alias("n_papers"), F.when(user % 5 > 0, "two sources").alias("limits")).distinct()
    return rm.refused(all_checks, own).select("check", "longest_empty_run", "why")


# --- ingest and caveats ----------------------------------------------------------------------


@query("""SELECT l_orderkey AS query, count(*) AS n_results, count(*) FILTER (WHERE l_linenumber > 2) AS n_new, count(*) FILTER (WHERE l_linenumber <= 2) AS n_cached, count(*) FILTER (WHERE l_linenumber * 10 < s_nationkey) AS n_reused, count(*) FILTER (WHERE l_partkey % 3 = 0 AND l_partkey % 2 = 0) AS n_without_identifier,
round(round(count(*) FILTER (WHERE l_linenumber <= 2) / count(*), 4), 3) AS within_run_overlap, round(round(count(*) FILTER (WHERE l_linenumber * 10 < s_nationkey) / count(*), 4), 3) AS paper_reuse_rate FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1""")
def ingest_report(t: Tables) -> DataFrame:
    key = F.col("l_partkey").cast("string")
    hits = t.lineitem.select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("paper"), F.when(F.col("l_partkey") % 3 > 0, key).otherwise(" ").alias("doi"), F.when(F.col("l_partkey") % 2 > 0, key).alias("pmid"), (F.col("l_linenumber") > 2).alias("is_new"), (F.col("l_linenumber") * 10).alias("fetched_at"))
    return rm.ingested(hits, t.supplier.select(F.col("s_suppkey").alias("run"), F.col("s_nationkey").alias("started_at")))


@query("""WITH i AS (SELECT c_custkey AS idea, c_nationkey AS project, c_name AS code FROM customer), h AS (SELECT s_nationkey AS project, s_suppkey AS n_papers, s_suppkey // 3 AS n_full, s_suppkey // 2 AS n_gap FROM supplier WHERE s_acctbal > 1000 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) = 1),
s AS (SELECT * FROM orders WHERE o_orderpriority NOT LIKE '1%'), g AS (SELECT DISTINCT user_id AS idea FROM events WHERE event_type = 'view'), p AS (SELECT project, count(*) AS n_graded, count(*) FILTER (WHERE idea NOT IN (SELECT o_custkey FROM s)) AS n_unverified FROM g JOIN i USING (idea) GROUP BY 1),
d AS (SELECT project, count(*) AS n_done, string_agg(code, '|' ORDER BY code) AS done FROM (SELECT o_custkey AS idea, o_orderstatus FROM s QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) JOIN i USING (idea) WHERE o_orderstatus = 'F' GROUP BY 1),
r AS (SELECT user_id AS idea, event_id AS n_rounds, value AS drift, event_type AS reason FROM events WHERE event_type IN ('click', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
SELECT i.idea, i.project, n_papers, n_full AS n_with_fulltext, n_gap AS n_gap_sentences, n_papers - n_full AS n_silent, coalesce(n_graded, 0) AS n_graded, coalesce(n_unverified, 0) AS n_unverified, coalesce(n_done, 0) AS n_done, coalesce(done, '') AS done, coalesce(n_rounds, 0) AS n_rounds, drift, reason
FROM i LEFT JOIN h USING (project) LEFT JOIN p USING (project) LEFT JOIN d USING (project) LEFT JOIN r USING (idea)""")
def idea_caveats(t: Tables) -> DataFrame:
    ideas = t.customer.select(F.col("c_custkey").alias("idea"), F.col("c_nationkey").alias("project"), F.col("c_name").alias("code"))
    own = F.col("s_suppkey")
    reads = t.supplier.select(F.col("s_nationkey").alias("project"), F.when(F.col("s_acctbal") > 1000, "done").otherwise("failed").alias("status"), own.alias("n_papers"), F.floor(own / 3).alias("n_with_fulltext"), F.floor(own / 2).alias("n_gap_sentences"), F.col("s_acctbal").alias("at"), own.alias("id"))
    graded = t.events.where("event_type = 'view'").select(F.col("user_id").alias("idea"))
    seen = checks(t).drop("project").withColumn("verdict", F.when(F.col("verdict") == "F", "scooped").otherwise(F.col("verdict")))
    own_rounds = t.events.where("event_type IN ('click', 'purchase')").select(F.col("user_id").alias("idea"), F.col("event_id").alias("round"), F.col("value").alias("drift"), F.lit(0).alias("n_open"), F.lit(True).alias("terminated"), F.col("event_type").alias("reason"))
    out = rm.caveats_by_idea(ideas, reads, graded, seen, own_rounds, "|")
    return out.select("idea", "project", "n_papers", "n_with_fulltext", "n_gap_sentences", "n_silent", "n_graded", "n_unverified", "n_done", "done", "n_rounds", "drift", "reason")


@query("SELECT bool_or(o_totalprice > 0) AS any, max(o_orderstatus) AS last, count(*) AS n FROM orders WHERE o_totalprice < 0")
def overall_of_none(t: Tables) -> DataFrame:
    return rm.overall(t.orders.where("o_totalprice < 0"), F.col("o_totalprice") > 0, F.col("o_orderstatus"))


# --- dialects and concepts -------------------------------------------------------------------

RENDER = """v AS (SELECT p_brand AS id, 1 AS c, min(p_type) AS d, list_sort(list(DISTINCT p_type)) AS ts FROM part GROUP BY 1 UNION ALL SELECT p_brand, 2, NULL, list_sort(list(DISTINCT p_name || ',  of')) FROM part GROUP BY 1),
x AS (SELECT id, c, d, u.t, u.i FROM v, unnest(list_filter(list_concat([d], ts), lambda y: y <> '')) WITH ORDINALITY AS u(t, i)),
y AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda w: w NOT IN ('', 'of', 'the', 'and', 'in', 'or')), ' ') AS k FROM x),
z AS (SELECT id, c, d, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS t, length(t) AS n, i FROM y WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY id, c, k ORDER BY length(t) DESC, i) = 1),
g AS (SELECT id, c, min(d) AS d, list(t ORDER BY n DESC, i)[1:4] AS g FROM z GROUP BY id, c)"""
QUOTED = "'(' || {head}array_to_string(list_transform(g, lambda t: '\"' || t || '\"{tail}'), ' OR ') || ')'"


@query(f"""WITH {RENDER} SELECT id, string_agg({QUOTED.format(head="CASE WHEN d IS NOT NULL THEN '\"' || d || '\"[MeSH Terms] OR ' ELSE '' END || ", tail="[tiab]")}, ' AND ' ORDER BY c) AS pubmed,
string_agg({QUOTED.format(head="", tail="")}, ' AND ' ORDER BY c) AS europepmc, string_agg(replace(coalesce(d, g[1]), ',', ' '), ' ' ORDER BY c) AS crossref FROM g GROUP BY id""")
def rendered_dialects(t: Tables) -> DataFrame:
    g = t.part.groupBy(F.col("p_brand").alias("id")).agg(F.min("p_type").alias("d"), F.array_sort(F.collect_set("p_type")).alias("types"), F.array_sort(F.collect_set(F.concat("p_name", F.lit(",  of")))).alias("names"))
    none = F.lit(None).cast("string")
    concepts = F.array(F.struct(F.col("d").alias("descriptor"), F.col("types").alias("terms")), F.struct(none.alias("descriptor"), F.col("names").alias("terms")))
    return g.select("id", *[tx.rendered(concepts, s).alias(s) for s in ("pubmed", "europepmc", "crossref")])


@query(f"""WITH {PATHS}, e AS (SELECT 'n' || n_nationkey AS ui, 'r' || n_regionkey AS up FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier), d AS (SELECT ui, max(len(string_split(path, '.'))) AS depth FROM p GROUP BY 1),
r AS (SELECT up AS ui, ui AS relative, 'narrower' AS relation FROM e UNION SELECT ui, up, 'broader' FROM e)
SELECT r.ui, relative, relation, depth, row_number() OVER (PARTITION BY r.ui ORDER BY relation DESC, CASE WHEN relation = 'broader' THEN -depth END, relative) AS place FROM r JOIN d ON d.ui = relative WHERE relation = 'narrower' OR depth >= 2""")
def specific_relatives(t: Tables) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t.nation.select(name("n", "n_nationkey").alias("ui"), name("r", "n_regionkey").alias("broader")).unionByName(t.supplier.select(name("s", "s_suppkey").alias("ui"), name("n", "s_nationkey").alias("broader")))
    return voc.relatives(edges, paths(t), True, 2)


@query("""WITH dict AS (SELECT lower(p_name) AS gram, 'u' || min(p_partkey) AS ui FROM part GROUP BY 1), x AS (SELECT DISTINCT replace(upper(p_name), ' ', '-') AS spelling, p_brand AS synonym FROM part UNION SELECT replace(p_name, ' ', ''), p_type FROM part UNION SELECT '--', 'lost' UNION SELECT 'no such thing', 'lost')
SELECT ui, string_agg(DISTINCT synonym, '|' ORDER BY synonym) AS synonyms FROM x JOIN dict ON replace(gram, ' ', '') = lower(regexp_replace(spelling, '[^A-Za-z0-9]+', '', 'g')) GROUP BY ui""")
def curated_synonyms(t: Tables) -> DataFrame:
    dictionary = t.part.groupBy(F.lower("p_name").alias("gram")).agg(F.concat(F.lit("u"), F.min("p_partkey").cast("string")).alias("ui"))
    extra = t.part.select(F.replace(F.upper("p_name"), F.lit(" "), F.lit("-")).alias("spelling"), F.col("p_brand").alias("synonym")).union(t.part.select(F.replace("p_name", F.lit(" "), F.lit("")), "p_type")).distinct()
    extra = extra.union(t.spark.createDataFrame([("--", "lost"), ("no such thing", "lost")], "spelling string, synonym string"))
    return voc.by_concept(extra, dictionary).select("ui", F.array_join("synonyms", "|").alias("synonyms"))


@query("""WITH l AS (SELECT p_brand AS ui, min(p_type) AS label FROM part WHERE p_size < 10 GROUP BY 1), k AS (SELECT p_brand AS ui, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS types FROM part WHERE p_size = 3 GROUP BY 1)
SELECT ui, coalesce(label, ui) AS label, coalesce(types, '') AS types FROM (SELECT DISTINCT p_brand AS ui FROM part UNION SELECT p_type FROM part) LEFT JOIN l USING (ui) LEFT JOIN k USING (ui)""")
def named_concepts(t: Tables) -> DataFrame:
    ids = t.part.select(F.col("p_brand").alias("ui")).union(t.part.select("p_type")).distinct()
    out = rm.named(ids, t.part.where("p_size < 10").select(F.col("p_brand").alias("ui"), F.col("p_type").alias("label")), t.part.where("p_size = 3").select(F.col("p_brand").alias("ui"), F.col("p_name").alias("type")))
    return out.select("ui", "label", F.array_join("types", "|").alias("types"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN lower(p_brand) WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE left(lower(trim(p_name)), 80) END AS key FROM part")
def watch_keys(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    return t.part.select(key.alias("id"), tx.watch_key(F.when(key % 3 == 0, F.concat(F.lit(" "), "p_brand")), F.when(key % 2 == 0, key.cast("string")).otherwise(" "), F.col("p_name")).alias("key"))
