"""Versions of a table that only ever grows: what was true when it was written stays readable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from papyrine.streaming.watch import versions


def append_version(df: DataFrame, table: str) -> int:
    """Write df as the next version of the table and give its number. A write that broke off has no mark and its number is taken again."""
    known = versions(df.sparkSession, table)
    number = known[-1] + 1 if known else 0
    df.write.mode("overwrite").parquet(f"{table}/v{number}")
    return number


def read_version(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """The rows of a version, the newest without a number."""
    known = versions(spark, table)
    if not known or (number is not None and number not in known):
        raise FileNotFoundError(f"{table} has no version{'' if number is None else f' {number}'}")
    return spark.read.parquet(f"{table}/v{known[-1] if number is None else number}")


def history(spark: SparkSession, table: str) -> DataFrame:
    """All versions one under another, with version."""
    known = versions(spark, table)
    if not known:
        raise FileNotFoundError(f"{table} has no version")
    out = None
    for v in known:
        rows = spark.read.parquet(f"{table}/v{v}").withColumn("version", F.lit(v))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def drift(spark: SparkSession, table: str, key: list[str], value: str) -> DataFrame:
    """(key, version, value, was) of the rows whose value differs from the key's in the version before that has it; a new key has not drifted."""
    rows = history(spark, table)
    before = F.lag(value).over(Window.partitionBy(*key).orderBy("version"))
    seen = F.lag("version").over(Window.partitionBy(*key).orderBy("version"))
    rows = rows.withColumn("was", before).withColumn("_seen", seen)
    return rows.where(F.col("_seen").isNotNull() & ~F.col("was").eqNullSafe(F.col(value))).select(*key, "version", value, "was")


def report_rows(ideas: DataFrame, tiers: DataFrame, verdicts: DataFrame, ranks: DataFrame, objections: DataFrame, rounds: DataFrame, at: Column) -> DataFrame:
    """What a report says about each idea, copied at write time: later changes of the sources do not reach it.

    ideas: (idea, project, title); tiers: (idea, tier, route, at, id); verdicts: (idea, method, verdict, limits, at, id), of which the last adversarial one counts;
    ranks: (idea, rank, at, id); objections: (idea, statement, severity, status), open unless resolved; rounds: (idea, round_no, drift, reason).
    """
    from papyrine.operators.relational import latest

    newest = [F.col("at").desc(), F.col("id").desc()]
    tier = latest(tiers, ["idea"], newest).select("idea", "tier", "route")
    said = latest(verdicts.where("method = 'adversarial'"), ["idea"], newest).select("idea", "verdict", F.col("limits").alias("caveats"))
    place = latest(ranks, ["idea"], newest).select("idea", "rank")
    is_open = ~F.coalesce(F.col("status").isin("resolved_by_evidence", "resolved_by_revision"), F.lit(False))
    against = objections.where(is_open).groupBy("idea").agg(F.count("*").alias("n_open"), F.count_if(F.col("severity") == "major").alias("n_major"), F.array_sort(F.collect_list("statement")).alias("open"))
    last = rounds.groupBy("idea").agg(F.max(F.struct("round_no", "drift", "reason")).alias("r")).select("idea", F.col("r.round_no").alias("n_rounds"), F.col("r.drift").alias("drift"), F.col("r.reason").alias("ended"))
    out = ideas.join(tier, "idea", "left").join(said, "idea", "left").join(place, "idea", "left").join(against, "idea", "left").join(last, "idea", "left")
    return out.fillna(0, ["n_open", "n_major", "n_rounds"]).withColumn("open", F.coalesce("open", F.array().cast("array<string>"))).withColumn("written_at", at)
