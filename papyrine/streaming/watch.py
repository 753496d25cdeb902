"""The collision watch as a stream: keys not seen before, each reported once, ever."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """State never expires: a key may come back after any time and is still known."""
    return stream.dropDuplicates(keys)


def drain(spark: SparkSession, source: str, schema, keys: list[str], sink: str, per_trigger: int = 2, glob: str | None = None) -> DataFrame:
    """Read all files that are there, a few a trigger, and append keys not seen before to the sink; a restart goes on where the last drain ended."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    fresh = first_seen(reader.parquet(source), keys)
    query = fresh.writeStream.format("parquet").option("path", sink).option("checkpointLocation", f"{sink}.progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)


def versions(spark: SparkSession, table: str) -> list[int]:
    """The versions of a table, oldest first: its folders v0, v1, .. whose write was committed."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(int(f.getPath().getParent().getName()[1:]) for f in found or [])


def current(spark: SparkSession, table: str) -> DataFrame:
    """The last version of a table that merge_late writes."""
    return spark.read.parquet(f"{table}/v{versions(spark, table)[-1]}")


def merge_late(spark: SparkSession, stream: DataFrame, table: str, merge) -> None:
    """Late evidence: each micro-batch makes the table's next version by merge(version before, batch).

    The caller writes v0. Batch k reads version k and writes k + 1, so a batch that is run again after a
    lost driver gives the same version, and the one before stays whole until the next is committed; older ones go.
    """

    def each(batch: DataFrame, number: int) -> None:
        before = [v for v in versions(spark, table) if v <= number]
        if not before:
            raise FileNotFoundError(f"{table} has no version at or before {number}")
        merge(spark.read.parquet(f"{table}/v{before[-1]}"), batch).write.mode("overwrite").parquet(f"{table}/v{number + 1}")
        for v in before[:-1]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v{v}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{table}.progress").trigger(availableNow=True).start().awaitTermination()
