"""The collision watch with its state: a watchlist, what is known of each topic, what each watch found, and a history of quiet days too.

Micro-batch k reads the baseline and what batches before k found, both append-only, and writes its own folders batch=k anew. A batch
that is run again after a lost driver therefore finds the same and reports nothing twice, and no table is ever rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papyrine.operators.discovery import unseen
from papyrine.operators.relational import latest, top

FOUND, HISTORY = "topic long, key string, seq long", "topic long, n_seen long, n_new long, collision boolean"


def watchlist(checks: DataFrame, ranks: DataFrame, watches: DataFrame, most: int = 20) -> DataFrame:
    """Topics worth watching, best ranked first, `most` a project: those whose last check of the adversarial kind is there to compare with.

    checks: (project, topic, method, verdict, at, id); ranks: (topic, rank, at, id); watches: (topic, at, id). Adds the rank in the newest tournament and the last watch.
    """
    newest = [F.col("at").desc(), F.col("id").desc()]
    base = latest(checks.where("method = 'adversarial'"), ["topic"], newest).select("project", "topic", F.col("id").alias("baseline"), "verdict", F.col("at").alias("checked_at"))
    place = latest(ranks, ["topic"], newest).select("topic", "rank")
    seen = latest(watches, ["topic"], newest).select("topic", F.col("at").alias("watched_at"))
    out = base.join(place.withColumnRenamed("rank", "place"), "topic", "left").join(seen, "topic", "left")
    return top(out, ["project"], [F.col("place").asc_nulls_last(), F.col("topic")], most).drop("rank")


def found(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """(topic, key, seq, batch) of all watches, or of those before a batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/found")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], FOUND + ", batch long")
    rows = spark.read.schema(FOUND + ", batch long").parquet(f"{root}/found")
    return rows if before is None else rows.where(F.col("batch") < before)


def history(spark: SparkSession, root: str) -> DataFrame:
    """(topic, n_seen, n_new, collision, batch): a row for each topic that a watch looked at, quiet ones included."""
    return spark.read.schema(HISTORY + ", batch long").parquet(f"{root}/history")


def watch(spark: SparkSession, stream: DataFrame, baseline: DataFrame, root: str) -> DataFrame:
    """Drain stream (topic, key, seq): keys that neither the baseline (topic, key) nor an earlier watch has, each once. A restart goes on where the last watch ended."""

    def each(batch: DataFrame, number: int) -> None:
        known = baseline.select("topic", "key").unionByName(found(spark, root, number).select("topic", "key"))
        rows = batch.where("key IS NOT NULL AND trim(key) <> ''").select(F.col("topic").cast("long"), F.col("key").cast("string"), F.col("seq").cast("long"))
        fresh = unseen(rows, known)
        fresh.select("topic", "key", "seq").write.mode("overwrite").parquet(f"{root}/found/batch={number}")
        new = spark.read.schema(FOUND).parquet(f"{root}/found/batch={number}").groupBy("topic").agg(F.count("*").alias("n_new"))
        looked = batch.groupBy(F.col("topic").cast("long").alias("topic")).agg(F.count("*").alias("n_seen"))
        days = looked.join(new, "topic", "left").fillna(0, ["n_new"]).withColumn("collision", F.col("n_new") > 0)
        days.select("topic", "n_seen", "n_new", "collision").write.mode("overwrite").parquet(f"{root}/history/batch={number}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return found(spark, root)


def admissible(watches: DataFrame) -> DataFrame:
    """watches: (verdict, n_new). Adds why: a watch cannot find that nothing exists, and says that something appeared only with what appeared."""
    claims = F.when(F.col("verdict") == "no_prior_art", "a watch cannot conclude that nothing exists").when(F.col("verdict").isin("scooped", "incremental") & (F.coalesce("n_new", F.lit(0)) == 0), "a verdict on prior work needs the work")
    return watches.withColumn("why", claims)
