"""Helpers shared by the operators: words, batches, Arrow plumbing, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from papyrine.session import dropped, reachable, stored

#: The six ASCII white-space characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def word_array(text: Column) -> Column:
    """Words of a text as an array, in order; null and blank texts give an empty array."""
    core = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANK_RUN))


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text; one longer text stands alone."""
    text, begin, held = batch.column(column), 0, 0
    sizes = pc.binary_length(text).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if i > begin and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, column: str, most: int = 1 << 20) -> DataFrame:
    """Apply work to bounded slices of rows. work gets a record batch and gives a dict of columns or a batch."""
    reachable(df.sparkSession)
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, most):
                out = work(part)
                if isinstance(out, dict):
                    out = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names=names)
                yield out

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest node reachable.

    Alternates the large-star and small-star contractions until nothing changes; every round is a
    map-side combined minimum and a join that adaptive execution can split where a node has very many edges.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, large.a == low.u).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        before, now = now, stored(small.where("a <> b").distinct(), name)
        dropped(before)  # the round before is not read again
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if mark == tuple(seen):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(seen)
