"""Moves on stage chains: each gives the next version of the table of runs; nothing is changed in place.

runs: (run, project, stage, status, pause_after, started_at, finished_at). A stage of a project is active at most once; a move that would make it so twice leaves it as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The states of a run that is on its way, and of one that waits for a person or for money.
ACTIVE, PARKED = ("pending", "running"), ("awaiting_review", "paused_budget")
COLUMNS = ("run", "project", "stage", "status", "pause_after", "started_at", "finished_at")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    order = [F.col("finished_at").desc_nulls_last(), F.col("started_at").desc_nulls_last(), F.col("run").desc()]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def following(plan: DataFrame) -> DataFrame:
    """plan (ord, stage, pauses) with next; a handful of rows."""
    return plan.select("stage", "pauses", F.lead("stage").over(Window.orderBy("ord")).alias("next"))


def made(project: Column, stage: Column, at: Column) -> Column:
    return F.concat_ws("/", project.cast("string"), stage, at.cast("string"))


def queued(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (project, stage, at). runs with a pending row for each, but where the stage is active already."""
    busy = runs.where(F.col("status").isin(*ACTIVE)).select("project", "stage").distinct()
    fresh = wanted.groupBy("project", "stage").agg(F.min("at").alias("at")).join(busy, ["project", "stage"], "left_anti")
    rows = fresh.select(made(F.col("project"), F.col("stage"), F.col("at")).alias("run"), "project", "stage", F.lit("pending").alias("status"), F.lit(None).cast("boolean").alias("pause_after"), F.lit(None).alias("started_at"), F.lit(None).alias("finished_at"))
    kinds = dict(runs.dtypes)
    return runs.select(*COLUMNS).unionByName(rows.select(*[F.col(c).cast(kinds[c]) for c in COLUMNS]))


def advanced(runs: DataFrame, finished: DataFrame, plan: DataFrame) -> DataFrame:
    """finished: (project, stage, ok, at), one a project. The newest active run of the stage is closed, or a row is written for one that was started by hand; the next stage is queued unless this one failed, is unknown, pauses or was the last.

    A run's own pause_after outranks the plan's.
    """
    open_ = newest(runs.where(F.col("status").isin(*ACTIVE)), ["project", "stage"]).select("project", "stage", F.col("run").alias("_open"), F.col("pause_after").alias("_pause"))
    moves = finished.join(F.broadcast(following(plan)).withColumn("_known", F.lit(True)), "stage", "left").join(open_, ["project", "stage"], "left")
    pause = F.coalesce("_pause", "pauses", F.lit(False))
    status = F.when(F.col("_known").isNull() | ~F.col("ok"), "failed").when(pause & F.col("next").isNotNull(), "awaiting_review").otherwise("done")
    moves = moves.withColumn("_status", status)
    closed = moves.where("_open IS NOT NULL").select(F.col("_open").alias("run"), "_status", F.col("at").alias("_at"))
    kinds = dict(runs.dtypes)
    own = runs.join(closed, "run", "left").withColumn("status", F.coalesce("_status", "status")).withColumn("finished_at", F.coalesce(F.col("_at").cast(kinds["finished_at"]), F.col("finished_at")))
    late = moves.where("_open IS NULL").select(made(F.col("project"), F.col("stage"), F.col("at")).alias("run"), "project", "stage", F.col("_status").alias("status"), F.lit(None).cast("boolean").alias("pause_after"), F.col("at").alias("started_at"), F.col("at").alias("finished_at"))
    after = own.select(*COLUMNS).unionByName(late.select(*[F.col(c).cast(kinds[c]) for c in COLUMNS]))
    return queued(after, moves.where("_status = 'done' AND next IS NOT NULL").select("project", F.col("next").alias("stage"), "at"))


def resumed(runs: DataFrame, projects: DataFrame, plan: DataFrame) -> DataFrame:
    """projects: (project, at). The newest parked run of each: one that has finished is done and its successor queued; one that never ran, since something was missing, is queued itself."""
    parked = newest(runs.where(F.col("status").isin(*PARKED)).join(projects.select("project", "at"), "project"), ["project"])
    parked = parked.join(F.broadcast(following(plan)), "stage", "left")
    ran = F.col("finished_at").isNotNull()
    change = parked.select("run", F.when(ran, "done").otherwise("pending").alias("_status"))
    own = runs.join(change, "run", "left").withColumn("status", F.coalesce("_status", "status")).select(*COLUMNS)
    return queued(own, parked.where(ran & F.col("next").isNotNull()).select("project", F.col("next").alias("stage"), "at"))


def stopped(runs: DataFrame, projects: DataFrame) -> DataFrame:
    """projects: (project, at). All that waits or runs of them is stopped; what was finished stays, since it did happen."""
    kind = dict(runs.dtypes)["finished_at"]
    met = runs.join(projects.select("project", F.col("at").alias("_at")), "project", "left")
    hit = F.col("_at").isNotNull() & F.col("status").isin(*ACTIVE, *PARKED)
    out = met.withColumns({"status": F.when(hit, "stopped").otherwise(F.col("status")), "finished_at": F.when(hit, F.col("_at").cast(kind)).otherwise(F.col("finished_at"))})
    return out.select(*COLUMNS)


def pausing(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """marks: (project, stage, pause). Whether active runs of these stages stop when they end."""
    met = runs.join(marks.select("project", "stage", F.col("pause").alias("_pause")), ["project", "stage"], "left")
    hit = F.col("_pause").isNotNull() & F.col("status").isin(*ACTIVE)
    return met.withColumn("pause_after", F.when(hit, F.col("_pause")).otherwise(F.col("pause_after"))).select(*COLUMNS)
