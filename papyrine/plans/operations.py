"""Operational read models on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papyrine.functions.measures import price, rate
from papyrine.operators import corpus, discovery, profile, progress, relational as rel
from papyrine.plans.catalog import Tables, query

USERS = "user_id AS project, event_type AS stage, ts AS at, event_id AS id, value"


def ev(t: Tables) -> DataFrame:
    return t.events.selectExpr("user_id AS project", "event_type AS stage", "ts AS at", "event_id AS id", "value", "props")


@query("SELECT project, stage, id, value FROM (SELECT user_id AS project, event_type AS stage, event_id AS id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return rel.latest(ev(t), ["project", "stage"], [F.col("at").desc(), F.col("id").desc()]).select("project", "stage", "id", "value")


@query("SELECT c.c_custkey, coalesce(o.o_orderkey, -1) AS o_orderkey, o.o_totalprice FROM customer c LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true")
def latest_lateral(t: Tables) -> DataFrame:
    """Spark's own lateral join with a limit numbers the rows behind a shuffle that loses the inner order; a window with the order does not."""
    last = rel.latest(t.orders, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_totalprice")
    return t.customer.join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1).cast("long")).alias("o_orderkey"), "o_totalprice")


@query("SELECT c_custkey, (SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS best FROM customer")
def latest_scalar(t: Tables) -> DataFrame:
    best = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("best"))
    return t.customer.select("c_custkey").join(best, "c_custkey", "left")


@query("SELECT event_id AS id, user_id AS project, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_row(t: Tables) -> DataFrame:
    return ev(t).orderBy(F.col("at").desc(), F.col("id").desc()).limit(1).select("id", "project", "value")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS n_priorities FROM customer")
def correlated_counts(t: Tables) -> DataFrame:
    return rel.counted(t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", {"n_orders": F.count("*"), "n_priorities": F.count_distinct("o_orderpriority")})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_in(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_orderpriority = '1-URGENT'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT count(*) AS customers, count(*) FILTER (WHERE o.k IS NULL) AS unverified FROM (SELECT DISTINCT c_custkey FROM customer) c LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON c.c_custkey = o.k")
def anti_unverified(t: Tables) -> DataFrame:
    known = t.orders.select(F.col("o_custkey").alias("k")).distinct()
    return t.customer.select("c_custkey").distinct().join(known, F.col("c_custkey") == F.col("k"), "left").agg(F.count("*").alias("customers"), F.count_if(F.col("k").isNull()).alias("unverified"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def delete_using(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders.where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, n.n_name AS nation, a.s_acctbal > b.s_acctbal AS a_richer FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey JOIN nation n ON n.n_nationkey = a.s_nationkey")
def role_playing_pairs(t: Tables) -> DataFrame:
    a, b = t.supplier.alias("a"), t.supplier.alias("b")
    met = a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).join(F.broadcast(t.nation), F.col("a.s_nationkey") == F.col("n_nationkey"))
    return met.select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b"), F.col("n_name").alias("nation"), (F.col("a.s_acctbal") > F.col("b.s_acctbal")).alias("a_richer"))


@query("SELECT DISTINCT p_partkey, n_name FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE o_orderpriority = '2-HIGH'")
def four_way_papers(t: Tables) -> DataFrame:
    met = t.part.select("p_partkey").join(t.lineitem.select("l_partkey", "l_orderkey"), F.col("p_partkey") == F.col("l_partkey")).join(t.orders.where("o_orderpriority = '2-HIGH'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return met.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("p_partkey", "n_name").distinct()


@query("SELECT p_partkey, CASE WHEN p_type ILIKE '%brass%' OR p_type ILIKE 'promo%' THEN 2 WHEN p_type ILIKE '%steel%' THEN 1 ELSE 0 END AS tier, p_size, p_retailprice FROM part ORDER BY tier DESC, p_size DESC NULLS LAST, p_retailprice DESC NULLS LAST, p_partkey LIMIT 50")
def venue_priority(t: Tables) -> DataFrame:
    tier = F.when(F.expr("p_type ILIKE ANY ('%brass%', 'promo%')"), 2).when(F.expr("p_type ILIKE ANY ('%steel%')"), 1).otherwise(0)
    return t.part.select("p_partkey", tier.alias("tier"), "p_size", "p_retailprice").orderBy(F.col("tier").desc(), F.col("p_size").desc_nulls_last(), F.col("p_retailprice").desc_nulls_last(), "p_partkey").limit(50)


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS usd FROM events GROUP BY event_type")
def spend_by_stage(t: Tables) -> DataFrame:
    return ev(t).groupBy("stage").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("usd")).orderBy(F.col("usd").desc_nulls_last())


@query("""WITH s AS (SELECT o_custkey, sum(o_totalprice) / 100 AS spent FROM orders GROUP BY o_custkey),
m AS (SELECT c_custkey AS project, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS budget, c_acctbal / 5 AS estimate, coalesce(spent, 0) AS spent FROM customer LEFT JOIN s ON o_custkey = c_custkey)
SELECT project, round(budget - spent, 4) AS remaining, CASE WHEN budget IS NULL THEN 'no budget set' WHEN budget - spent <= 0 THEN 'spent' WHEN estimate > budget - spent THEN 'estimate above what is left' END AS note,
budget IS NULL OR NOT (budget - spent <= 0 OR estimate > budget - spent) AS allowed FROM m""")
def budget_gate(t: Tables) -> DataFrame:
    projects = t.customer.select(F.col("c_custkey").alias("project"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("budget"), (F.col("c_acctbal") / 5).alias("estimate"))
    return progress.gate(projects, t.orders.select(F.col("o_custkey").alias("project"), (F.col("o_totalprice") / 100).alias("usd")), 4).select("project", "remaining", "note", "allowed")


@query("""WITH p(flag, i, o) AS (VALUES ('A', 5.0, 25.0), ('N', 3.0, 15.0), ('R', 1.0, 5.0)), k AS (SELECT *, CAST(l_quantity AS DECIMAL(12, 0)) AS q, CAST(i AS DECIMAL(8, 4)) AS di, CAST(o AS DECIMAL(8, 4)) AS dout FROM lineitem JOIN p ON flag = l_returnflag)
SELECT l_orderkey, l_linenumber, CAST(round((CAST(l_partkey AS DECIMAL(12, 0)) * di + CAST(l_suppkey AS DECIMAL(12, 0)) * dout + q * di * CAST(0.1 AS DECIMAL(3, 2)) + CAST(l_linenumber AS DECIMAL(12, 0)) * di * CAST(1.25 AS DECIMAL(3, 2)))
* CASE WHEN l_linestatus = 'F' THEN CAST(0.5 AS DECIMAL(2, 1)) ELSE CAST(1.0 AS DECIMAL(2, 1)) END * CAST(0.000001 AS DECIMAL(7, 6)), 6) AS DOUBLE) AS usd FROM k""")
def token_price(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame([("A", 5.0, 25.0), ("N", 3.0, 15.0), ("R", 1.0, 5.0)], "l_returnflag string, rate_in double, rate_out double")
    usd = price(F.col("rate_in"), F.col("rate_out"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"), F.col("l_linenumber"), F.col("l_linestatus") == "F")
    return t.lineitem.join(F.broadcast(prices), "l_returnflag").select("l_orderkey", "l_linenumber", usd.alias("usd"))


@query("SELECT stage, count(*) AS n, count(*) FILTER (WHERE hot) AS hot FROM (SELECT event_type AS stage, value > 50 AS hot, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 GROUP BY stage")
def tier_histogram(t: Tables) -> DataFrame:
    return rel.latest(ev(t), ["project"], [F.col("at").desc(), F.col("id").desc()]).groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("hot"))


@query("""SELECT o_orderpriority AS tier, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END NULLS LAST, o_orderkey) AS place
FROM orders QUALIFY place <= 20""")
def board_grouped(t: Tables) -> DataFrame:
    rank = F.when(F.col("id") % 3 != 0, F.col("o_totalprice"))
    return rel.top(t.orders.select(F.col("o_orderpriority").alias("tier"), F.col("o_orderkey").alias("id"), "o_totalprice"), ["tier"], [rank.asc_nulls_last(), F.col("id")], 20).select("tier", "id", F.col("rank").alias("place"))


@query("SELECT user_id AS project, count(*) AS n, count(CASE WHEN event_type <> 'view' THEN event_type END) AS decided, count(*) - count(CASE WHEN event_type <> 'view' THEN event_type END) AS undecided FROM events GROUP BY user_id")
def undecided_counts(t: Tables) -> DataFrame:
    decided = F.count(F.when(F.col("stage") != "view", F.col("stage")))
    return ev(t).groupBy("project").agg(F.count("*").alias("n"), decided.alias("decided"), (F.count("*") - decided).alias("undecided"))


STAGE_ROWS = [(1, "view", None, False), (2, "click", None, False), (3, "signup", "first", True), (4, "purchase", "second", True), (5, "error", None, False)]
STAGE_SQL = "(VALUES (1, 'view', false), (2, 'click', false), (3, 'signup', true), (4, 'purchase', true), (5, 'error', false)) AS st(ord, stage, pauses)"
STATUS_SQL = "CASE event_id % 7 WHEN 0 THEN 'awaiting_review' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' WHEN 3 THEN 'stopped' ELSE 'done' END"


def last_runs(t: Tables) -> DataFrame:
    last = rel.latest(ev(t), ["project", "stage"], [F.col("at").desc(), F.col("id").desc()])
    k = F.col("id") % 7
    status = F.when(k == 0, "awaiting_review").when(k == 1, "running").when(k == 2, "failed").when(k == 3, "stopped").otherwise("done")
    return last.select("project", "stage", status.alias("status"), F.when(status.isin("done", "awaiting_review", "failed", "stopped"), F.col("at")).alias("finished_at"))


@query(f"""WITH l AS (SELECT user_id AS project, event_type AS stage, {STATUS_SQL} AS status, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events),
r AS (SELECT project, l.stage, ord, status, CASE WHEN status <> 'running' THEN ts END AS f FROM l JOIN {STAGE_SQL} ON st.stage = l.stage WHERE n = 1),
p AS (SELECT *, status = 'awaiting_review' AND NOT EXISTS (SELECT 1 FROM r x WHERE x.project = r.project AND x.ord > r.ord AND (x.status IN ('pending', 'running') OR x.f > r.f)) AS parked FROM r)
SELECT project, CASE WHEN bool_or(parked) THEN 'awaiting_you' WHEN bool_or(status = 'running') THEN 'running' WHEN bool_or(stage = 'error' AND status = 'done') THEN 'done' WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status = 'stopped') THEN 'stopped' ELSE 'idle' END AS state,
arg_min(stage, ord) FILTER (WHERE parked) AS waits_at FROM p GROUP BY project""")
def chain_state(t: Tables) -> DataFrame:
    return progress.chain_state(last_runs(t), progress.stages(t.spark, STAGE_ROWS), "error")


@query(f"""SELECT event_id AS id, e.event_type AS stage, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN pauses AND ord < 5 THEN 'awaiting_review' ELSE 'done' END AS status,
CASE WHEN event_id % 5 <> 0 AND NOT pauses THEN (SELECT stage FROM {STAGE_SQL.replace('AS st', 'AS s2')} WHERE s2.ord = st.ord + 1) END AS next_stage FROM events e JOIN {STAGE_SQL} ON st.stage = e.event_type""")
def stage_decision(t: Tables) -> DataFrame:
    return progress.decisions(ev(t).select("id", "stage", (F.col("id") % 5 != 0).alias("ok")), progress.stages(t.spark, STAGE_ROWS))


@query(f"""WITH c AS (SELECT user_id AS project, event_type AS stage, count(*) AS n, count(*) FILTER (WHERE value > 20) AS done FROM events GROUP BY ALL)
SELECT u.project, st.stage, st.ord, coalesce(n, 0) AS n, coalesce(done, 0) AS done, CASE WHEN coalesce(n, 0) = 0 THEN 'todo' WHEN done = n THEN 'done' ELSE 'doing' END AS state
FROM (SELECT DISTINCT user_id AS project FROM events) u CROSS JOIN {STAGE_SQL} LEFT JOIN c ON c.project = u.project AND c.stage = st.stage""")
def progress_steps(t: Tables) -> DataFrame:
    counts = ev(t).groupBy("project", "stage").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("done"))
    return progress.steps(progress.stages(t.spark, STAGE_ROWS), counts, ev(t).select("project").distinct())


@query("""WITH k AS (SELECT user_id AS topic, event_id AS seq, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS h FROM events),
g AS (SELECT topic, h, sum(h) OVER (PARTITION BY topic ORDER BY seq) AS grp FROM k WHERE h IS NOT NULL)
SELECT topic, max(c) AS longest FROM (SELECT topic, grp, count(*) FILTER (WHERE h = 0) AS c FROM g GROUP BY topic, grp) GROUP BY topic""")
def longest_empty_run(t: Tables) -> DataFrame:
    hits = F.when(F.col("stage") == "purchase", 1).when(F.col("stage") != "error", 0)
    return discovery.longest_empty_run(ev(t).select(F.col("project").alias("topic"), F.col("id").alias("seq"), hits.alias("n_hits")))


@query("SELECT user_id AS project, event_type AS stage, min(event_id) AS first_id FROM events GROUP BY user_id, event_type")
def first_seen_angles(t: Tables) -> DataFrame:
    return rel.latest(ev(t), ["project", "stage"], [F.col("id")]).select("project", "stage", F.col("id").alias("first_id"))


@query("""SELECT user_id AS topic, floor(value) AS key, min(event_id) AS seq FROM events e WHERE ts >= TIMESTAMP '2024-01-20' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.ts < TIMESTAMP '2024-01-20' AND b.user_id = e.user_id AND floor(b.value) = floor(e.value)) GROUP BY ALL""")
def collision_diff(t: Tables) -> DataFrame:
    rows = ev(t).select(F.col("project").alias("topic"), F.floor("value").cast("double").alias("key"), F.col("id").alias("seq"), "at")
    return discovery.unseen(rows.where("at >= TIMESTAMP_NTZ '2024-01-20 00:00:00'"), rows.where("at < TIMESTAMP_NTZ '2024-01-20 00:00:00'"))


@query("""WITH c AS (SELECT user_id AS topic, CASE WHEN user_id % 3 = 0 THEN 'adjacent' ELSE 'no_prior_art' END AS verdict, count(*) FILTER (WHERE event_type = 'purchase') AS added, count(*) FILTER (WHERE event_type = 'purchase' AND value < 10) AS revived FROM events GROUP BY ALL)
SELECT *, CASE WHEN verdict = 'no_prior_art' AND revived > 0 THEN 'contradicted' WHEN verdict = 'no_prior_art' AND added > 0 THEN 'weakened' WHEN added > 0 THEN 'note' END AS level FROM c""")
def late_merge_contradiction(t: Tables) -> DataFrame:
    bought = F.col("stage") == "purchase"
    counts = ev(t).groupBy(F.col("project").alias("topic")).agg(F.count_if(bought).alias("added"), F.count_if(bought & (F.col("value") < 10)).alias("revived"))
    return discovery.contradiction(counts.withColumn("verdict", F.when(F.col("topic") % 3 == 0, "adjacent").otherwise("no_prior_art")))


@query("""WITH s AS (SELECT l_partkey AS topic, round(l_discount * 10, 2) AS drift, l_linenumber AS round, CAST(l_quantity AS BIGINT) % 4 AS open_cited, CASE WHEN l_shipdate < TIMESTAMP '1995-01-01' THEN ' by hand ' END AS reason, l_orderkey AS id FROM lineitem)
SELECT id, round, CASE WHEN drift > 0.5 THEN 'drift' WHEN open_cited = 0 THEN 'nothing cited is open' WHEN round >= 6 THEN 'round cap' WHEN reason IS NOT NULL THEN 'by hand' END AS why FROM s""")
def debate_termination(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.round(F.col("l_discount") * 10, 2).alias("drift"), F.col("l_linenumber").alias("round"), (F.col("l_quantity").cast("long") % 4).alias("open_cited"), F.when(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp_ntz"), " by hand ").alias("reason"))
    return discovery.termination(rows, rounds=6).select("id", "round", "why")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'price too low' WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'finished but low' WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN 'unknown status' END AS why FROM orders""")
def vet_rows(t: Tables) -> DataFrame:
    rules = [("price too low", "o_totalprice < 1000"), ("finished but low", "o_orderstatus = 'F' AND o_orderpriority = '5-LOW'"), ("unknown status", "o_orderstatus NOT IN ('F', 'O', 'P')")]
    return rel.vetted(t.orders, rules).select("o_orderkey", "why")


@query("""WITH pool AS (SELECT p_partkey AS paper, p_brand || p_partkey AS doi, 'm' || (p_partkey % 500) AS pmid FROM part),
d AS (SELECT lower(doi) AS k, min(paper) AS p FROM pool GROUP BY ALL), m AS (SELECT pmid AS k, min(paper) AS p FROM pool GROUP BY ALL),
c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_brand || p_partkey) END AS doi, CASE WHEN l_linenumber % 3 = 0 THEN 'm' || l_suppkey WHEN l_linenumber % 3 = 1 THEN 'x' END AS pmid FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, coalesce(d.p, m.p, -1) AS paper, CASE WHEN d.p <> m.p THEN 'conflict' WHEN coalesce(d.p, m.p) IS NOT NULL THEN 'verified' ELSE 'unknown' END AS state FROM c LEFT JOIN d ON lower(c.doi) = d.k LEFT JOIN m ON c.pmid = m.k""")
def citation_verify(t: Tables) -> DataFrame:
    doi = F.concat("p_brand", F.col("p_partkey").cast("string"))
    pool = t.part.select(F.col("p_partkey").alias("paper"), doi.alias("doi"), F.concat(F.lit("m"), (F.col("p_partkey") % 500).cast("string")).alias("pmid"))
    k = F.col("l_linenumber")
    claims = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.when(k % 2 == 0, F.upper(doi)).alias("doi"), F.when(k % 3 == 0, F.concat(F.lit("m"), F.col("l_suppkey").cast("string"))).when(k % 3 == 1, "x").alias("pmid"))
    return rel.cited(claims, pool).select("l_orderkey", "l_linenumber", F.coalesce("paper", F.lit(-1)).alias("paper"), "state")


@query("""SELECT key, arg_min(origin, ord) AS origin FROM (SELECT l_partkey AS key, 'first' AS origin, 1 AS ord FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 'second', 2 FROM lineitem WHERE l_quantity > 40) GROUP BY key""")
def citable_pool(t: Tables) -> DataFrame:
    a = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("key"), F.lit("first").alias("origin"), F.lit(1).alias("ord"))
    b = t.lineitem.where("l_quantity > 40").select(F.col("l_partkey").alias("key"), F.lit("second").alias("origin"), F.lit(2).alias("ord"))
    return a.unionByName(b).groupBy("key").agg(F.min_by("origin", "ord").alias("origin"))


@query("""WITH h AS (SELECT user_id AS run, event_type AS query, CAST(floor(value) AS BIGINT) AS paper, event_id, event_id % 4 = 0 AS reused FROM events)
SELECT run, count(*) AS n_hits, count(DISTINCT paper) AS n_papers, count(DISTINCT CASE WHEN reused THEN paper END) AS n_reused, count(DISTINCT query) AS n_queries, round(count(DISTINCT CASE WHEN reused THEN paper END) / count(DISTINCT paper), 4) AS paper_reuse_rate, round((count(*) - count(DISTINCT paper)) / count(*), 4) AS within_run_overlap FROM h GROUP BY run""")
def run_metrics(t: Tables) -> DataFrame:
    return corpus.run_metrics(ev(t).select(F.col("project").alias("run"), F.col("stage").alias("query"), F.floor("value").alias("paper"), (F.col("id") % 4 == 0).alias("is_reused")))


@query("""SELECT user_id AS run, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS fresh, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-15') AS cached, coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) > 0 AS bought, round(count(*) FILTER (WHERE event_type = 'error') / nullif(count(*) FILTER (WHERE event_type IN ('error', 'purchase')), 0), 4) AS error_rate FROM events GROUP BY user_id""")
def ingest_counters(t: Tables) -> DataFrame:
    new, bad = F.col("at") >= F.lit("2024-01-15").cast("timestamp_ntz"), F.col("stage") == "error"
    return ev(t).groupBy(F.col("project").alias("run")).agg(F.count_if(new).alias("fresh"), F.count_if(~new).alias("cached"), (F.coalesce(F.sum(F.when(F.col("stage") == "purchase", F.col("value"))), F.lit(0)) > 0).alias("bought"), rate(F.count_if(bad), F.count_if(F.col("stage").isin("error", "purchase"))).alias("error_rate"))


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey AS project, o_orderpriority AS topic, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS source, o_orderdate AS at FROM orders)
SELECT id, project FROM q a WHERE EXISTS (SELECT 1 FROM q b WHERE b.project = a.project AND b.topic = a.topic AND b.source IS NOT DISTINCT FROM a.source AND (b.at < a.at OR (b.at = a.at AND b.id < a.id)))""")
def repeat_queries(t: Tables) -> DataFrame:
    q = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderpriority").alias("topic"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("source"), F.col("o_orderdate").alias("at"))
    return corpus.repeats(q).select("id", "project")


@query("SELECT user_id AS query, CAST(floor(value) AS BIGINT) AS paper, min(event_id) AS rank FROM events GROUP BY ALL")
def hit_min_rank(t: Tables) -> DataFrame:
    return corpus.least_rank(ev(t).select(F.col("project").alias("query"), F.floor("value").alias("paper"), F.col("id").alias("rank")))


@query("""WITH a AS (SELECT doc_id, lang, source, text FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, upper(lang) AS lang, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'new' END AS source, left(text, 20) AS text FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, coalesce(b.lang, a.lang) AS lang, coalesce(nullif(b.source, ''), a.source) AS source, coalesce(a.text, b.text) AS text, a.doc_id IS NULL AS was_new FROM a FULL JOIN b USING (doc_id)""")
def upsert_latest(t: Tables) -> DataFrame:
    old = t.documents.where("doc_id % 3 <> 0")
    new = t.documents.where("doc_id % 5 <> 0").select("doc_id", F.upper("lang").alias("lang"), F.when(F.col("doc_id") % 2 == 0, "").otherwise("new").alias("source"), F.left("text", F.lit(20)).alias("text"))
    return rel.upsert(old, new, ["doc_id"], {"lang": "incoming", "source": "filled", "text": "existing"})


@query("""WITH h AS (SELECT source, count(*) AS version, min(lang) AS content FROM documents GROUP BY source), b AS (SELECT source, max(lang) AS content FROM documents GROUP BY source)
SELECT b.source, coalesce(h.version, 0) + 1 AS version, b.content FROM b LEFT JOIN h ON h.source = b.source WHERE h.content IS NULL OR h.content <> b.content""")
def version_append(t: Tables) -> DataFrame:
    by_source = t.documents.groupBy("source")
    return rel.next_version(by_source.agg(F.count("*").alias("version"), F.min("lang").alias("content")), "source", "version", by_source.agg(F.max("lang").alias("content")), "content")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view') AND user_id = 5")
def optional_filters(t: Tables) -> DataFrame:
    return rel.where_all(t.events, event_type=["click", "view"], user_id=5, value=None).select("event_id", "user_id", "event_type")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(CAST(json_extract(props, '$.missing') AS BIGINT), -1) AS missing, '{\"id\":' || event_id || ',\"kind\":\"' || event_type || '\"}' AS doc FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing").cast("long"), F.lit(-1)).alias("missing"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("doc"))


NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM {n}) AS n_rows, CAST((SELECT count(*) FROM information_schema.columns WHERE table_name = '{n}') AS INT) AS n_columns" for n in NAMES))
def table_stats(t: Tables) -> DataFrame:
    return profile.table_stats({n: getattr(t, n) for n in NAMES})


def cells(name: str, kind: str, missing: str = "CAST(0 AS DOUBLE)", numbers: bool = False, personal: str = "false") -> str:
    shown = f"min(CAST({name} AS DOUBLE)), max(CAST({name} AS DOUBLE))" if numbers else "NULL, NULL"
    return f"SELECT '{name}' AS name, '{kind}' AS dtype, {missing} AS missing_rate, count(DISTINCT {name}) AS n_unique, {personal} AS personal, {shown.split(', ')[0]} AS min, {', '.join(shown.split(', ')[1:])} AS max, NOT {personal} AND count(DISTINCT {name}) = count(*) AS unique_per_row FROM customer"


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, CAST(year(ts) - 10 AS INT) AS since FROM events")
def iso_times(t: Tables) -> DataFrame:
    from papyrine.functions.text import iso, years_before

    return t.events.select("event_id", iso(F.col("ts")).alias("iso"), years_before(F.col("ts"), 10).alias("since"))


@query(" UNION ALL ".join([cells("c_custkey", "integer", numbers=True), cells("c_name", "text", personal="true"), cells("c_nationkey", "integer", numbers=True), cells("c_acctbal", "number", numbers=True), cells("c_mktsegment", "text")]))
def column_profile(t: Tables) -> DataFrame:
    return profile.columns(t.customer)


VISITS = "vs AS (SELECT event_id, 'p' || user_id AS patient, strftime(ts, '%Y-%m-%d') AS visit_date, CASE WHEN value > 10 THEN event_type ELSE ' ' END AS city, value AS lab_value FROM events)"


def visits(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("patient"), F.date_format("ts", "yyyy-MM-dd").alias("visit_date"), F.when(F.col("value") > 10, F.col("event_type")).otherwise(" ").alias("city"), F.col("value").alias("lab_value"))


KINDS = {"area": ("city", "region"), "time": ("date", "visit"), "site": ("hospital", "ward")}


@query(f"""WITH {VISITS}, n AS (SELECT count(*) AS n FROM vs) SELECT 1 AS place, 'event_id' AS name, 'integer' AS dtype, 0.0 AS missing_rate, count(DISTINCT event_id) AS n_unique, NULL AS first, NULL AS last, true AS unique_per_row, NULL AS joins_on FROM vs
UNION ALL SELECT 2, 'patient', 'text', 0.0, count(DISTINCT patient), NULL, NULL, count(DISTINCT patient) = count(*), NULL FROM vs UNION ALL SELECT 3, 'visit_date', 'date', 0.0, count(DISTINCT visit_date), min(visit_date), max(visit_date), false, 'time' FROM vs
UNION ALL SELECT 4, 'city', 'text', round(1 - count(*) FILTER (WHERE city <> ' ') / count(*), 4), count(DISTINCT nullif(city, ' ')), NULL, NULL, false, 'area' FROM vs UNION ALL SELECT 5, 'lab_value', 'number', 0.0, count(DISTINCT lab_value), NULL, NULL, count(DISTINCT lab_value) = count(*), NULL FROM vs""")
def columns_described(t: Tables) -> DataFrame:
    return profile.described(visits(t), KINDS).select(F.col("place").cast("int").alias("place"), "name", "dtype", "missing_rate", "n_unique", "first", "last", "unique_per_row", "joins_on")


@query(f"WITH {VISITS}, g AS (SELECT patient, count(*) AS n FROM vs GROUP BY 1) SELECT CASE WHEN max(n) > 1 THEN 'longitudinal' ELSE 'cross-sectional' END AS shape, 'patient' AS key, count(*) AS n_groups, max(n) AS most_rows, CASE WHEN max(n) > 1 THEN 'patient repeats and visit_date gives them an order' ELSE 'patient is one row a value' END AS why FROM g")
def structure_detected(t: Tables) -> DataFrame:
    return profile.detected(visits(t))


@query("""WITH v AS (SELECT 'event_type' AS name, event_type AS value FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events), c AS (SELECT name, value, count(*) AS n FROM v GROUP BY ALL)
SELECT * FROM c WHERE name IN (SELECT name FROM c GROUP BY name HAVING count(*) <= 12)""")
def level_histogram(t: Tables) -> DataFrame:
    return profile.levels(t.events.select("event_type", "user_id"))


@query("SELECT count(*) AS n_groups, max(n) AS most_rows, count(*) FILTER (WHERE n > 1) AS repeats, CASE WHEN count(*) FILTER (WHERE n > 1) = 0 THEN 'cross-sectional' ELSE 'longitudinal' END AS shape FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)")
def row_structure(t: Tables) -> DataFrame:
    return profile.structure(t.events, "user_id", True)


@query("SELECT conv_id, turn, length(text) + length(regexp_replace(text, '[\\x00-\\x{2E80}]', '', 'g')) AS weight, regexp_matches(text, '[^@ ]+@[^@ ]+\\.[a-z]+') AS has_mail FROM conversations")
def pii_flags(t: Tables) -> DataFrame:
    from papyrine.functions.text import wide_length

    return t.conversations.select("conv_id", "turn", wide_length(F.col("text")).cast("long").alias("weight"), F.col("text").rlike(r"[^@ ]+@[^@ ]+\.[a-z]+").alias("has_mail"))


@query("""WITH h AS (SELECT user_id AS project, event_type AS input, floor(value / 25) AS d, lag(floor(value / 25)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events)
SELECT project, count(*) AS versions, count(*) FILTER (WHERE b IS NULL) AS added, count(*) FILTER (WHERE b <> d) AS changed FROM h GROUP BY project""")
def expansion_drift(t: Tables) -> DataFrame:
    h = rel.drifted(ev(t).withColumn("d", F.floor(F.col("value") / 25)), ["project", "stage"], [F.col("at"), F.col("id")], "d")
    return h.groupBy("project").agg(F.count("*").alias("versions"), F.count_if(F.col("before").isNull()).alias("added"), F.count_if("changed").alias("changed"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def claim_pending(t: Tables) -> DataFrame:
    return rel.claim(t.orders.where("o_orderstatus = 'P'"), [F.col("o_orderdate"), F.col("o_orderkey")], 20).select("o_orderkey", "o_custkey")


@query("SELECT event_id, CASE WHEN props LIKE '%\"k\":%' THEN '' ELSE 'k,' END || 'z' AS missing FROM events")
def missing_keys(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.array_join(rel.lacking(F.json_object_keys("props"), ("k", "z")), ",").alias("missing"))


@query("""WITH b AS (SELECT p_brand AS concept, min(p_type) AS label FROM part GROUP BY 1), s AS (SELECT DISTINCT p_brand AS concept, p_type AS term FROM part),
z AS (SELECT concept, term, row_number() OVER (PARTITION BY concept ORDER BY len(list_intersect(string_split(lower(term), ' '), string_split(lower(label), ' '))) DESC, length(term), term) AS rank FROM s JOIN b USING (concept)) SELECT * FROM z WHERE rank <= 4""")
def term_variants(t: Tables) -> DataFrame:
    label = t.part.groupBy(F.col("p_brand").alias("concept")).agg(F.split(F.lower(F.min("p_type")), " ").alias("l"))
    terms = t.part.select(F.col("p_brand").alias("concept"), F.col("p_type").alias("term")).distinct().withColumn("t", F.split(F.lower("term"), " "))
    return rel.variants(terms.join(label, "concept"), 4).select("concept", "term", "rank")


@query()
def watch_stream(t: Tables) -> DataFrame:
    import uuid

    from papyrine.session import shared_folder
    from papyrine.streaming.watch import drain

    sink = f"{shared_folder(t.spark)}/papyrine/watch-{uuid.uuid4().hex}"
    return drain(t.spark, t.folder, t.events.schema, ["user_id", "event_type"], sink, glob="events.parquet").select("user_id", "event_type")
