"""Rules over rows, the stateful watch, reports as they were written, statistics of files, shares of a background."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from papyrine.operators import rules
from papyrine.plans.catalog import Tables, query
from papyrine.session import shared_folder, stored
from papyrine.sources import background as bg, stored_state as st
from papyrine.streaming import collision


def scratch(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/papyrine/{name}-{uuid.uuid4().hex}"


# --- rules -----------------------------------------------------------------------------------

#: Every line of an order as a row of each stored table; the expressions read the same in both dialects.
WIDE = {
    "left_idea": "CASE WHEN l_orderkey % 3 > 0 THEN l_partkey END", "left_anchor": "CASE WHEN l_orderkey % 3 < 2 AND l_linenumber > 1 THEN l_suppkey END",
    "right_idea": "CASE WHEN l_linenumber < 3 THEN l_partkey END", "right_anchor": "CASE WHEN l_linenumber >= 3 THEN l_suppkey END",
    "idea_id": "CASE WHEN l_suppkey % 2 = 0 THEN l_partkey END", "anchor_id": "CASE WHEN l_partkey % 2 = 0 THEN l_suppkey END",
    "reason": "CASE l_linenumber WHEN 1 THEN 'already_published' WHEN 2 THEN 'not_feasible' WHEN 3 THEN 'not my method' END",
    "merged_into": "CASE WHEN l_orderkey % 5 = 0 THEN l_partkey % 20 END", "id": "l_suppkey % 20",
    "cutoff": "CASE WHEN l_partkey % 4 > 0 THEN 1700 + l_partkey % 500 END", "term_groups": "CASE WHEN l_suppkey % 3 = 0 THEN 'x' END",
    "tier": "CASE WHEN l_linenumber < 6 THEN substr('ABCDE', l_linenumber, 1) END", "missing": "CASE WHEN l_orderkey % 2 = 0 THEN 'data' END", "route": "CASE WHEN l_orderkey % 7 > 0 THEN 'ask' END",
    "method": "CASE l_orderkey % 4 WHEN 0 THEN 'mechanical' WHEN 1 THEN 'adversarial' WHEN 2 THEN 'by hand' END", "verdict": "CASE l_partkey % 4 WHEN 0 THEN 'scooped' WHEN 1 THEN 'no_prior_art' WHEN 2 THEN 'done' END",
    "coverage_limits": "CASE WHEN l_suppkey % 2 = 1 THEN 'two sources' END", "severity": "CASE l_linenumber WHEN 1 THEN 'major' WHEN 2 THEN 'minor' WHEN 3 THEN 'fatal' END",
    "axis": "CASE l_suppkey % 3 WHEN 0 THEN 'novelty' WHEN 1 THEN 'style' END", "citation_support": "CASE l_partkey % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' END",
    "cited_paper_id": "CASE WHEN l_orderkey % 4 = 1 THEN l_partkey END", "cited": "CASE WHEN l_orderkey % 4 = 2 THEN 'a paper' END", "rebuttal_score": "CASE WHEN l_linenumber < 7 THEN l_linenumber END",
    "status": "CASE l_orderkey % 3 WHEN 0 THEN 'resolved_by_evidence' WHEN 1 THEN 'unresolved' END", "proposer_model": "CASE WHEN l_linenumber > 1 THEN l_returnflag END", "critic_model": "l_linestatus",
    "drift": "CASE WHEN l_linenumber < 6 THEN l_discount * 12 END", "distance": "l_tax", "round_no": "l_linenumber - 1", "usd_budget": "CASE WHEN l_linenumber > 2 THEN l_tax END", "usd_spent": "l_discount - 0.01",
    "auto_advance_to": "CASE l_linenumber WHEN 1 THEN 'dedup' WHEN 2 THEN 'party' END",
}
#: The checks as SQL has them; a row is bad where one is false.
CHECKS = {
    ("match", "left is one side"): "(left_idea IS NULL) <> (left_anchor IS NULL)", ("match", "right is one side"): "(right_idea IS NULL) <> (right_anchor IS NULL)", ("ranking", "ranked is one side"): "(idea_id IS NULL) <> (anchor_id IS NULL)",
    ("reduction", "reason is allowed"): "reason IN ('already_published', 'not_feasible')", ("idea", "not merged into itself"): "merged_into IS NULL OR merged_into <> id", ("anchor", "cutoff is a year"): "cutoff IS NULL OR (cutoff BETWEEN 1800 AND 2100)",
    ("anchor", "terms need a cutoff"): "term_groups IS NULL OR cutoff IS NOT NULL", ("feasibility", "tier is a letter"): "tier IN ('A', 'B', 'C', 'D')", ("feasibility", "B and C need a route"): "tier NOT IN ('B', 'C') OR (missing IS NOT NULL AND route IS NOT NULL)",
    ("novelty", "method is allowed"): "method IS NULL OR method IN ('mechanical', 'adversarial', 'debate_recheck', 'collision_watch')", ("novelty", "verdict is allowed"): "verdict IS NULL OR verdict IN ('scooped', 'incremental', 'adjacent', 'no_prior_art')",
    ("novelty", "a negative needs bounds"): "verdict IS DISTINCT FROM 'no_prior_art' OR coverage_limits IS NOT NULL", ("objection", "severity is allowed"): "severity IS NULL OR severity IN ('major', 'minor')",
    ("objection", "axis is allowed"): "axis IS NULL OR axis IN ('contribution', 'novelty', 'soundness', 'feasibility')", ("objection", "support is allowed"): "citation_support IS NULL OR citation_support IN ('strong', 'weak', 'irrelevant')",
    ("objection", "strong needs a paper"): "citation_support IS DISTINCT FROM 'strong' OR cited_paper_id IS NOT NULL OR cited IS NOT NULL", ("objection", "score is in range"): "rebuttal_score IS NULL OR rebuttal_score BETWEEN 1 AND 5",
    ("objection", "status is allowed"): "status IS NULL OR status IN ('resolved_by_evidence', 'resolved_by_revision', 'unresolved')", ("objection", "conceding needs four"): "status IS DISTINCT FROM 'resolved_by_evidence' OR (rebuttal_score IS NOT NULL AND rebuttal_score >= 4)",
    ("debate", "models differ"): "proposer_model IS NULL OR critic_model IS NULL OR proposer_model <> critic_model", ("debate", "ratios are in range"): "(drift IS NULL OR drift BETWEEN 0 AND 1) AND (distance IS NULL OR distance BETWEEN 0 AND 1)", ("debate", "rounds count from one"): "round_no >= 1",
    ("report", "sections are whole"): "list_has_all(sections, ['title', 'background', 'method', 'references', 'novelty', 'feasibility', 'objections', 'prework'])", ("run", "budget is no debt"): "(usd_budget IS NULL OR usd_budget >= 0) AND usd_spent >= 0",
    ("run", "next stage is allowed"): "auto_advance_to IS NULL OR auto_advance_to IN ('dedup', 'tournament', 'feasibility', 'novelty', 'debate', 'report')",
}
SECTIONS = "['title', 'background', 'method', 'references', 'novelty', 'feasibility', 'objections', 'prework', 'more']"
ROWS = f"wide AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {c}' for c, e in WIDE.items())}, {SECTIONS}[1:7 + l_linenumber % 3] AS sections FROM lineitem)"


def wide(t: Tables) -> DataFrame:
    sections = "slice(array('title', 'background', 'method', 'references', 'novelty', 'feasibility', 'objections', 'prework', 'more'), 1, 7 + l_linenumber % 3) AS sections"
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", *[f"{e} AS {c}" for c, e in WIDE.items()], sections)


@query(f"WITH {ROWS} " + " UNION ALL ".join(f"SELECT '{table}' AS \"table\", '{name}' AS rule, count(*) FILTER (WHERE NOT ({check})) AS n_bad FROM wide" for (table, name), check in CHECKS.items()))
def rule_counts(t: Tables) -> DataFrame:
    return rules.counts(wide(t), rules.RULES)


OBJECTIONS = ", ".join(f"CASE WHEN NOT ({check}) THEN '{name}' END" for (table, name), check in CHECKS.items() if table == "objection")


@query(f"WITH {ROWS}, j AS (SELECT *, list_filter([{OBJECTIONS}], lambda x: x IS NOT NULL) AS why FROM wide) SELECT l_orderkey, l_linenumber, array_to_string(why, '; ') AS why FROM j WHERE len(why) > 0")
def objections_rejected(t: Tables) -> DataFrame:
    return rules.split(wide(t), rules.of("objection"))[1].select("l_orderkey", "l_linenumber", F.array_join("why", "; ").alias("why"))


@query(f"WITH {ROWS} SELECT l_orderkey, l_linenumber, severity, status FROM wide WHERE {' AND '.join(f'coalesce({check}, true)' for (table, _), check in CHECKS.items() if table == 'objection')}")
def objections_accepted(t: Tables) -> DataFrame:
    return rules.split(wide(t), rules.of("objection"))[0].select("l_orderkey", "l_linenumber", "severity", "status")


@query("SELECT o_custkey, o_orderpriority, count(*) AS n_active FROM orders WHERE o_orderstatus IN ('P', 'F') GROUP BY ALL HAVING count(*) > 1")
def queued_twice(t: Tables) -> DataFrame:
    return rules.one_active(t.orders, ["o_custkey", "o_orderpriority"], F.col("o_orderstatus").isin("P", "F"))


# --- the watch -------------------------------------------------------------------------------

SINCE = "2024-01-20 00:00:00"


def watched(t: Tables) -> str:
    """The events since a day as a stream, those before it as the baseline; the root of the watch's tables."""
    root = scratch(t, "collision")
    early = t.events.where(f"ts < TIMESTAMP_NTZ '{SINCE}'")
    baseline = stored(early.select(F.col("user_id").alias("topic"), F.floor("value").cast("string").alias("key")).distinct(), "baseline")
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).where(f"ts >= TIMESTAMP_NTZ '{SINCE}'")
    collision.watch(t.spark, stream.select(F.col("user_id").alias("topic"), F.floor("value").cast("string").alias("key"), F.col("event_id").alias("seq")), baseline, root)
    return root


LATE = f"l AS (SELECT user_id AS topic, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS key, event_id AS seq FROM events WHERE ts >= TIMESTAMP '{SINCE}'), b AS (SELECT DISTINCT user_id AS topic, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS key FROM events WHERE ts < TIMESTAMP '{SINCE}')"


@query(f"WITH {LATE} SELECT topic, key, min(seq) AS seq FROM l WHERE (topic, key) NOT IN (SELECT topic, key FROM b) GROUP BY ALL")
def collision_watch(t: Tables) -> DataFrame:
    return collision.found(t.spark, watched(t)).select("topic", "key", "seq")


@query(f"WITH {LATE}, n AS (SELECT topic, count(DISTINCT key) AS n FROM l WHERE (topic, key) NOT IN (SELECT topic, key FROM b) GROUP BY topic) SELECT topic, count(*) AS n_seen, coalesce(max(n), 0) AS n_new, coalesce(max(n), 0) > 0 AS collision FROM l LEFT JOIN n USING (topic) GROUP BY topic")
def watch_history(t: Tables) -> DataFrame:
    return collision.history(t.spark, watched(t)).select("topic", "n_seen", "n_new", "collision")


@query("""WITH c AS (SELECT o_custkey % 50 AS project, o_custkey AS topic, o_orderkey AS id, o_orderdate AS made, CASE o_orderstatus WHEN 'F' THEN 'adversarial' ELSE 'mechanical' END AS method FROM orders),
b AS (SELECT project, topic, id AS baseline FROM c WHERE method = 'adversarial' QUALIFY row_number() OVER (PARTITION BY topic ORDER BY made DESC, id DESC) = 1),
w AS (SELECT user_id AS topic, max(ts) AS watched_at FROM events GROUP BY 1), r AS (SELECT c_custkey AS topic, CAST(floor(c_acctbal) AS BIGINT) AS place FROM customer)
SELECT project, topic, baseline, place, watched_at FROM b LEFT JOIN r USING (topic) LEFT JOIN w USING (topic) QUALIFY row_number() OVER (PARTITION BY project ORDER BY place NULLS LAST, topic) <= 20""")
def watchlist(t: Tables) -> DataFrame:
    checks = t.orders.select((F.col("o_custkey") % 50).alias("project"), F.col("o_custkey").alias("topic"), F.when(F.col("o_orderstatus") == "F", "adversarial").otherwise("mechanical").alias("method"), F.lit("adjacent").alias("verdict"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    ranks = t.customer.select(F.col("c_custkey").alias("topic"), F.floor("c_acctbal").alias("rank"), F.lit(0).alias("at"), F.col("c_custkey").alias("id"))
    watches = t.events.select(F.col("user_id").alias("topic"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return collision.watchlist(checks, ranks, watches).select("project", "topic", "baseline", "place", "watched_at")


# --- reports as they were written ------------------------------------------------------------


def report_inputs(t: Tables, tiers: DataFrame) -> DataFrame:
    """Customers as ideas, their orders as gradings, verdicts and objections, events as debate rounds."""
    order = t.orders.select(F.col("o_custkey").alias("idea"), "o_orderstatus", "o_orderpriority", F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    ideas = t.customer.select(F.col("c_custkey").alias("idea"), F.col("c_nationkey").alias("project"), F.col("c_name").alias("title"))
    verdicts = order.select("idea", F.when(F.col("o_orderstatus") == "P", "mechanical").otherwise("adversarial").alias("method"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderpriority").alias("limits"), "at", "id")
    ranks = t.customer.select(F.col("c_custkey").alias("idea"), F.floor("c_acctbal").alias("rank"), F.lit(0).alias("at"), F.lit(0).alias("id"))
    objections = order.select("idea", F.concat(F.lit("no "), F.col("id").cast("string")).alias("statement"), F.when(F.col("id") % 3 == 0, "major").otherwise("minor").alias("severity"), F.when(F.col("o_orderstatus") == "F", "resolved_by_evidence").alias("status"))
    rounds = t.events.select(F.col("user_id").alias("idea"), F.col("event_id").alias("round_no"), F.col("value").alias("drift"), F.col("event_type").alias("reason"))
    return st.report_rows(ideas, tiers, verdicts, ranks, objections, rounds, F.lit("now"))


@query("""WITH o AS (SELECT o_custkey AS idea, *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders), v AS (SELECT * FROM o WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY idea ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
a AS (SELECT idea, count(*) AS n_open, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_major, string_agg('no ' || o_orderkey, '|' ORDER BY 'no ' || o_orderkey) AS open FROM o WHERE o_orderstatus <> 'F' GROUP BY idea), r AS (SELECT user_id AS idea, max(event_id) AS n_rounds, arg_max(value, event_id) AS drift, arg_max(event_type, event_id) AS ended FROM events GROUP BY 1)
SELECT c_custkey AS idea, c_nationkey AS project, t.o_orderpriority AS tier, v.o_orderstatus AS verdict, v.o_orderpriority AS caveats, CAST(floor(c_acctbal) AS BIGINT) AS rank, coalesce(n_open, 0) AS n_open, coalesce(n_major, 0) AS n_major, coalesce(open, '') AS open, coalesce(n_rounds, 0) AS n_rounds, drift, ended
FROM customer LEFT JOIN o t ON t.idea = c_custkey AND t.n = 1 LEFT JOIN v ON v.idea = c_custkey LEFT JOIN a ON a.idea = c_custkey LEFT JOIN r ON r.idea = c_custkey""")
def report_as_written(t: Tables) -> DataFrame:
    """The first version of the reports, read after every tier has changed and a second one was written."""
    tiers = t.orders.select(F.col("o_custkey").alias("idea"), F.col("o_orderpriority").alias("tier"), F.lit("ask").alias("route"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"))
    table = scratch(t, "reports")
    st.append_version(report_inputs(t, tiers), table)
    st.append_version(report_inputs(t, tiers.withColumn("tier", F.lit("changed"))), table)
    return st.read_version(t.spark, table, 0).select("idea", "project", "tier", "verdict", "caveats", "rank", "n_open", "n_major", F.array_join("open", "|").alias("open"), "n_rounds", "drift", "ended")


@query("""SELECT o_custkey AS idea, CAST(1 AS BIGINT) AS version, CASE WHEN sum(o_totalprice) > 500000 THEN 'large' ELSE 'small' END AS tier, CASE WHEN sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') > 500000 THEN 'large' ELSE 'small' END AS was
FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AND was <> tier""")
def stored_drift(t: Tables) -> DataFrame:
    """What an earlier version said otherwise."""
    table = scratch(t, "tiers")
    for part in (t.orders.where("o_orderstatus = 'F'"), t.orders):
        st.append_version(part.groupBy(F.col("o_custkey").alias("idea")).agg(F.when(F.sum("o_totalprice") > 500000, "large").otherwise("small").alias("tier")), table)
    return st.drift(t.spark, table, ["idea"], "tier").withColumn("version", F.col("version").cast("long"))


# --- files and backgrounds -------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", CAST(1 AS BIGINT) AS n_files, count(*) AS n_rows FROM {n}" for n in ("customer", "orders", "lineitem", "part", "supplier")))
def file_statistics(t: Tables) -> DataFrame:
    """Rows by the footers; sizes differ from store to store, so they are left to the tests."""
    return bg.file_stats({n: getattr(t, n) for n in ("customer", "orders", "lineitem", "part", "supplier")}).select("table", "n_files", "n_rows")


def counted_types(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_brand").alias("ui")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT p_brand AS ui, count(DISTINCT l_orderkey) AS df FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem)
SELECT ui, count(*) AS n, round(df / (SELECT n FROM n), 6) AS share, df / (SELECT n FROM n) > 0.16 AS is_generic FROM part JOIN b ON ui = p_brand GROUP BY ui, df""")
def background_shares(t: Tables) -> DataFrame:
    """A background written as compressed JSON and read back."""
    path = scratch(t, "background")
    uses = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("ui")).agg(F.count_distinct("l_orderkey").alias("df"))
    whole = uses.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ui", "df")))).alias("df")).join(t.lineitem.agg(F.count_distinct("l_orderkey").alias("n_papers")))
    whole.select("n_papers", "df").write.option("compression", "gzip").json(path)
    return bg.with_share(counted_types(t), bg.background(t.spark, path), 0.16).withColumn("is_generic", F.col("share") > 0.16)


@query("SELECT p_brand AS ui, count(*) AS n, CAST(0 AS DOUBLE) AS share, false AS is_generic FROM part GROUP BY 1")
def background_missing(t: Tables) -> DataFrame:
    return bg.with_share(counted_types(t), bg.background(t.spark, scratch(t, "nowhere")))


# --- moves on chains -------------------------------------------------------------------------

PLAN = [(1, "dedup", None, False), (2, "tournament", None, False), (3, "feasibility", None, True), (4, "novelty", None, True), (5, "debate", None, True), (6, "report", None, False)]
NAMES = "['dedup', 'tournament', 'feasibility', 'novelty', 'debate', 'report']"
#: Each customer's last two orders as runs; the stage follows the priority, the state the order's.
CHAIN_RUNS = f"""ru AS (SELECT 'r' || o_orderkey AS run, o_custkey AS project, {NAMES}[CAST(left(o_orderpriority, 1) AS INT)] AS stage, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'awaiting_review' END AS status,
CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 2 = 0 END AS pause_after, o_orderkey AS started_at, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS finished_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 2),
pl AS (SELECT unnest({NAMES}) AS stage, unnest([false, false, true, true, true, false]) AS pauses, unnest({NAMES}[2:] || [NULL]) AS next)"""


def chain_runs(t: Tables) -> DataFrame:
    from papyrine.operators.relational import top

    key = F.col("o_orderkey")
    stage = F.get(F.array(*[F.lit(p[1]) for p in PLAN]), F.left("o_orderpriority", F.lit(1)).cast("int") - 1)
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("awaiting_review")
    rows = top(t.orders, ["o_custkey"], [key.desc()], 2)
    return rows.select(F.concat(F.lit("r"), key.cast("string")).alias("run"), F.col("o_custkey").alias("project"), stage.alias("stage"), status.alias("status"), F.when(key % 7 == 0, key % 2 == 0).alias("pause_after"), key.alias("started_at"), F.when(key % 3 > 0, key).alias("finished_at"))


@query(f"""WITH {CHAIN_RUNS}, fi AS (SELECT c_custkey AS project, {NAMES}[1 + c_custkey % 6] AS stage, c_acctbal > 0 AS ok FROM customer), op AS (SELECT * FROM ru WHERE status IN ('pending', 'running') QUALIFY row_number() OVER (PARTITION BY project, stage ORDER BY finished_at DESC NULLS LAST, started_at DESC NULLS LAST, run DESC) = 1),
mv AS (SELECT fi.project, fi.stage, op.run AS own, next, CASE WHEN NOT ok THEN 'failed' WHEN coalesce(op.pause_after, pauses) AND next IS NOT NULL THEN 'awaiting_review' ELSE 'done' END AS st FROM fi JOIN pl USING (stage) LEFT JOIN op ON op.project = fi.project AND op.stage = fi.stage),
af AS (SELECT ru.run, ru.project, ru.stage, coalesce(st, status) AS status, pause_after, started_at, CASE WHEN st IS NOT NULL THEN 99 ELSE finished_at END AS finished_at FROM ru LEFT JOIN mv ON mv.own = ru.run UNION ALL SELECT project || '/' || stage || '/99', project, stage, st, NULL, 99, 99 FROM mv WHERE own IS NULL)
SELECT * FROM af UNION ALL SELECT project || '/' || next || '/99', project, next, 'pending', NULL, NULL, NULL FROM mv WHERE st = 'done' AND next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM af WHERE af.project = mv.project AND af.stage = mv.next AND af.status IN ('pending', 'running'))""")
def chain_advanced(t: Tables) -> DataFrame:
    """Each customer reports one stage as finished."""
    from papyrine.operators import chains, progress

    finished = t.customer.select(F.col("c_custkey").alias("project"), F.get(F.array(*[F.lit(p[1]) for p in PLAN]), (F.col("c_custkey") % 6).cast("int")).alias("stage"), (F.col("c_acctbal") > 0).alias("ok"), F.lit(99).cast("long").alias("at"))
    return chains.advanced(chain_runs(t), finished, progress.stages(t.spark, PLAN))


@query(f"""WITH {CHAIN_RUNS}, pk AS (SELECT ru.*, next FROM ru JOIN pl USING (stage) WHERE status = 'awaiting_review' QUALIFY row_number() OVER (PARTITION BY project ORDER BY finished_at DESC NULLS LAST, started_at DESC NULLS LAST, run DESC) = 1),
af AS (SELECT ru.* REPLACE (CASE WHEN pk.run IS NULL THEN ru.status WHEN pk.finished_at IS NOT NULL THEN 'done' ELSE 'pending' END AS status) FROM ru LEFT JOIN pk ON pk.run = ru.run)
SELECT * FROM af UNION ALL SELECT project || '/' || next || '/99', project, next, 'pending', NULL, NULL, NULL FROM pk WHERE finished_at IS NOT NULL AND next IS NOT NULL AND NOT EXISTS (SELECT 1 FROM af WHERE af.project = pk.project AND af.stage = pk.next AND af.status IN ('pending', 'running'))""")
def chain_resumed(t: Tables) -> DataFrame:
    from papyrine.operators import chains, progress

    return chains.resumed(chain_runs(t), t.customer.select(F.col("c_custkey").alias("project"), F.lit(99).cast("long").alias("at")), progress.stages(t.spark, PLAN))


@query(f"""WITH {CHAIN_RUNS}, s AS (SELECT c_custkey AS project FROM customer WHERE c_acctbal < 0) SELECT run, project, stage, CASE WHEN hit THEN 'stopped' ELSE status END AS status, pause_after, started_at, CASE WHEN hit THEN 99 ELSE finished_at END AS finished_at FROM (SELECT *, project IN (SELECT project FROM s) AND status IN ('running', 'awaiting_review') AS hit FROM ru)""")
def chain_stopped(t: Tables) -> DataFrame:
    from papyrine.operators import chains

    return chains.stopped(chain_runs(t), t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("project"), F.lit(99).cast("long").alias("at")))


# --- late evidence ---------------------------------------------------------------------------


@query("SELECT user_id AS topic, event_type AS kind, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def late_counts(t: Tables) -> DataFrame:
    """Counts up to a day, and a stream of what came later, merged into the next version of the table."""
    from papyrine.streaming.watch import current, merge_late

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("topic", "kind").agg(F.sum("n").alias("n"), F.max("most").alias("most"))

    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col("user_id").alias("topic"), F.col("event_type").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("value").alias("most"))

    table = scratch(t, "late")
    summed(rows(t.events.where(f"ts < TIMESTAMP_NTZ '{SINCE}'"))).write.parquet(f"{table}/v0")
    stream = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder).where(f"ts >= TIMESTAMP_NTZ '{SINCE}'")
    merge_late(t.spark, rows(stream), table, lambda old, new: summed(old.unionByName(new)))
    return current(t.spark, table)


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'p' || p_partkey END AS code, 'p' || p_partkey AS id, p_name AS title, p_type AS statement FROM part")
def idea_lines(t: Tables) -> DataFrame:
    """Ideas as JSON lines in as many files as Spark writes."""
    from papyrine.sources import records

    path, own = scratch(t, "ideas"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    t.part.select(own.alias("id"), F.when(F.col("p_size") % 2 == 0, own).alias("code"), F.col("p_name").alias("title"), F.col("p_type").alias("statement")).write.json(path)
    return records.ideas(t.spark, path).select("code", "id", "title", "statement")
