"""Stage chains: state of a project, next decision, progress, budget gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

STAGES = "ord int, stage string, review string, pauses boolean"


def stages(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The stage dimension; a handful of rows."""
    return spark.createDataFrame(rows, STAGES)


def chain_state(latest: DataFrame, plan: DataFrame, final: str) -> DataFrame:
    """latest: (project, stage, status, finished_at), the last run of each stage. Parked (unless a later stage acted after) > running > done > failed > stopped > idle."""
    runs = latest.join(F.broadcast(plan), "stage")
    after = Window.partitionBy("project").orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    busy = F.coalesce(F.max(F.col("status").isin("pending", "running")).over(after), F.lit(False))
    later = F.coalesce(F.max("finished_at").over(after) > F.col("finished_at"), F.col("finished_at").isNull() & F.max("finished_at").over(after).isNotNull(), F.lit(False))
    parked = runs.withColumn("parked", F.col("status").isin("awaiting_review", "paused_budget") & ~busy & ~later)
    flag = lambda c: F.coalesce(F.max(c), F.lit(False))
    out = parked.groupBy("project").agg(flag("parked").alias("p"), flag(F.col("status").isin("pending", "running")).alias("r"), flag((F.col("stage") == final) & (F.col("status") == "done")).alias("d"), flag(F.col("status") == "failed").alias("f"), flag(F.col("status") == "stopped").alias("s"), F.min(F.when(F.col("parked"), F.struct("ord", "stage")))["stage"].alias("waits_at"))
    state = F.when(F.col("p"), "awaiting_you").when(F.col("r"), "running").when(F.col("d"), "done").when(F.col("f"), "failed").when(F.col("s"), "stopped").otherwise("idle")
    return out.select("project", state.alias("state"), "waits_at")


def decisions(finished: DataFrame, plan: DataFrame) -> DataFrame:
    """finished: (id, stage, ok). Status of the finished stage and the next one, if it may start."""
    nxt = plan.withColumn("next", F.lead("stage").over(Window.orderBy("ord")))
    met = finished.join(F.broadcast(nxt), "stage", "left")
    status = F.when(F.col("ord").isNull() | ~F.col("ok"), "failed").when(F.col("pauses") & F.col("next").isNotNull(), "awaiting_review").otherwise("done")
    return met.withColumn("status", status).withColumn("next_stage", F.when((F.col("status") == "done") & F.col("ord").isNotNull(), F.col("next"))).select("id", "stage", "status", "next_stage")


def steps(plan: DataFrame, counts: DataFrame, project: DataFrame) -> DataFrame:
    """counts: (project, stage, n, done). Every project with every stage, in order; the stage dimension has a handful of rows."""
    grid = project.join(F.broadcast(plan.select("ord", "stage")))
    return grid.join(counts, ["project", "stage"], "left").fillna(0, ["n", "done"]).withColumn("state", F.when(F.col("n") == 0, "todo").when(F.col("done") == F.col("n"), "done").otherwise("doing"))


def gate(projects: DataFrame, spent: DataFrame, digits: int = 2) -> DataFrame:
    """projects: (project, budget, estimate); spent: (project, usd). No budget: allowed, with a note; nothing left or less than the estimate: stopped."""
    met = projects.join(spent.groupBy("project").agg(F.sum("usd").alias("spent")), "project", "left").fillna(0.0, ["spent"])
    left = F.col("budget") - F.col("spent")
    why = F.when(F.col("budget").isNull(), "no budget set").when(left <= 0, "spent").when(F.col("estimate") > left, "estimate above what is left")
    return met.withColumn("remaining", F.round(left, digits)).withColumn("note", why).withColumn("allowed", F.col("budget").isNull() | why.isNull())
