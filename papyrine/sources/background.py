"""Dictionaries and background counts from compressed JSON; a background that is not there is an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DICTIONARY = "terms map<string,string>, labels map<string,string>, semantic_types map<string,array<string>>, tree_numbers map<string,array<string>>"
BACKGROUND = "n_papers long, df map<string,long>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file fits the path, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def dictionary(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four maps of a dictionary as tables: terms (gram, ui), labels (ui, label), types (ui, type) and paths (ui, path)."""
    whole = spark.read.schema(DICTIONARY).option("multiLine", True).json(path)
    pairs = lambda c, k, v: whole.select(F.explode(c).alias(k, v))
    return {
        "terms": pairs("terms", "gram", "ui"), "labels": pairs("labels", "ui", "label"),
        "types": pairs("semantic_types", "ui", "ts").select("ui", F.explode("ts").alias("type")), "paths": pairs("tree_numbers", "ui", "ps").select("ui", F.explode("ps").alias("path")),
    }


def background(spark: SparkSession, path: str | None) -> tuple[DataFrame, int]:
    """((ui, df), number of papers); without a file no concept has a share."""
    if not path or not exists(spark, path):
        return spark.createDataFrame([], "ui string, df long"), 0
    whole = spark.read.schema(BACKGROUND).option("multiLine", True).json(path)
    return whole.select(F.explode("df").alias("ui", "df")), (whole.agg(F.max("n_papers")).first()[0]) or 0


def broadcastable(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its rows, counted, come to `most` bytes at the most; else df as it is."""
    width = sum({"string": 64, "long": 8, "bigint": 8, "int": 4, "double": 8, "boolean": 1}.get(k, 128) for _, k in df.dtypes)
    return F.broadcast(df) if df.count() * width <= most else df


def with_share(concepts: DataFrame, known: tuple[DataFrame, int], most: float = 0.02) -> DataFrame:
    """concepts (ui, ...) with share of the background's papers, 0 where unknown, and is_generic."""
    df, n = known
    out = concepts.join(broadcastable(df.select("ui", F.col("df").alias("_df"))), "ui", "left")
    share = F.round(F.coalesce("_df", F.lit(0)) / F.lit(n), 6) if n else F.lit(0.0)
    return out.withColumn("share", share).withColumn("is_generic", F.col("share") > most).drop("_df")


def anchors(spark: SparkSession, folder: str, name: str, known: tuple[str, ...]) -> DataFrame:
    """A bundled set of anchors by its name, which must be one of the known ones: no caller's path reaches the store."""
    if name not in known:
        raise ValueError(f"unknown set {name!r}")
    kind = "anchors array<struct<external_id:string,title:string,statement:string,grade_contribution:string,grade_feasibility:string,origin:string,field:string,cutoff:string,term_groups:array<array<string>>>>"
    return spark.read.schema(kind).option("multiLine", True).json(f"{folder}/{name}.json").select(F.explode("anchors").alias("a")).select("a.*")


def file_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_files, n_rows, n_bytes, row_bytes) from footers and file listings: only the files' own columns are asked for, so no data page is read."""
    out = None
    for name, df in tables.items():
        files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path", "file_size").agg(F.count("*").alias("n"))
        row = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("n_bytes"))
        row = row.select(F.lit(name).alias("table"), "n_files", "n_rows", "n_bytes", F.when(F.col("n_rows") > 0, F.round(F.col("n_bytes") / F.col("n_rows"), 2)).alias("row_bytes"))
        out = row if out is None else out.unionByName(row)
    return out
