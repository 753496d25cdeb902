"""Sinks: JSON, partitions replaced, snapshots with a restore drill, Markdown, templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Rewrite only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore_drill(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """(name, n_before, n_after, same) of every table of a snapshot."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n_before")).join(spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("n_after"))).select(F.lit(name).alias("name"), "n_before", "n_after", F.expr("n_before = n_after").alias("same"))
        out = row if out is None else out.unionByName(row)
    return out


def markdown(blocks: DataFrame) -> DataFrame:
    """blocks: (doc, ord, kind, text). One Markdown text per document; a document's blocks are a report's, tens of them."""
    line = F.when(F.col("kind") == "title", F.concat(F.lit("# "), "text")).when(F.col("kind") == "heading", F.concat(F.lit("## "), "text")).when(F.col("kind") == "item", F.concat(F.lit("- "), "text")).otherwise(F.col("text"))
    return blocks.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("markdown"))


def template(spark: SparkSession, header: list[str], path: str) -> None:
    """A CSV template: a byte order mark and the header."""
    spark.createDataFrame([("﻿" + ",".join(header),)], "value string").coalesce(1).write.mode("overwrite").text(path)
