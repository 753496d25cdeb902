"""Mixing sources to target weights by capped water-filling.

Sources get shares of a word budget in proportion to their weights; a source whose share exceeds its
cap (max_epochs times its size) is clamped there and the excess is shared again among the others by
weight, until no source is above its cap. The level at which this ends is found in closed form from
prefix sums over the sources, ordered by the level at which each one reaches its cap.

Rows that repeat a doc_id are documents of their own; those that are equal in source, id and text too share a place in the
order and are numbered there, each with its own part.

Every document is then taken floor(target / source size) whole times, and the fractional rest of a
source is filled by its documents in a seeded random order until the rest is used up; the document at
the end of that order is taken in part. No task sees a whole source: documents are dealt into
buckets by their place in the seeded order, only bucket totals are summed up, and only the one bucket
in which the rest of a source ends is put in order.

Defined cases: null or blank text has size 0 and is taken 0 words; a null source is a source of its own
and sorts last; a source of size 0 has target 0; an empty table gives no rows; other columns are ignored by `mixture` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from papyrine.llm.common import word_array, word_count
from papyrine.session import stored

BUCKETS = 1 << 16


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """sources: (source, source_size), one row each. Adds weight and target. One small row per source meets in a window."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("fills_at"), F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    levels = (
        sources.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    )
    # The first source (by fills_at) that the level of the sources from it on does not fill; none: all are full.
    water = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(everything)["level"]
    return levels.withColumn("water", water).select(
        "source", "source_size", "weight", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water"))).alias("target")
    )


def _placed(seed: int, id_col: str, text_col: str) -> list:
    """Columns for the seeded order: bucket, then turn within it, by id and text."""
    first, second = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col))
    return [F.pmod(first, F.lit(BUCKETS)).cast("int").alias("_bucket"), second.alias("_turn")]


def plan(docs: DataFrame, weights=(5, 2, 1), share=1.5, max_epochs=2.0, seed=17, id_col="doc_id", text_col="text", source_col="source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sized, by_source, edge): sizes of all documents, what each source takes, and the words taken in the bucket where a source's rest ends."""
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *_placed(seed, id_col, text_col)), "sized")
    totals = stored(sized.groupBy("source", "_bucket").agg(F.sum("size").alias("words")), "totals")
    goal = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(max_epochs)))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    run = Window.partitionBy("source").orderBy("_bucket")
    cut = (
        totals.withColumn("upto", F.sum("words").over(run)).join(goal.select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("upto") >= F.col("rest")) & (F.col("words") > 0))
        .groupBy("source").agg(F.min(F.struct("_bucket", (F.col("rest") - F.col("upto") + F.col("words")).alias("need"))).alias("cut"))
    )
    by_source = stored(
        goal.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", F.coalesce(F.col("cut._bucket"), F.lit(0)).alias("cut_bucket"), F.coalesce(F.col("cut.need"), F.lit(0)).alias("need")),
        "by_source",
    )
    turn = Window.partitionBy("source").orderBy("_turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    alike = F.row_number().over(Window.partitionBy("source", "_turn").orderBy("doc_id"))
    edge = (
        sized.join(by_source.select(F.col("source").alias("_s"), "cut_bucket", "need"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("cut_bucket")))
        .withColumn("_before", F.coalesce(F.sum("size").over(turn), F.lit(0)))
        .select(F.col("source").alias("_e"), F.col("_turn").alias("_t"), alike.alias("_k"), F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.col("_before"))).cast("long").alias("_part"))
    )
    return sized, by_source, stored(edge, "edge")


def _parts(rows: DataFrame, by_source: DataFrame, edge: DataFrame, order: list) -> DataFrame:
    """Adds source_size, target, whole and _part to rows with _id, _source, _size, _bucket and _turn; only rows of the buckets that are cut are numbered, equal ones by `order`."""
    out = rows.join(by_source.withColumnRenamed("source", "_s"), F.col("_source").eqNullSafe(F.col("_s")), "left")
    cut = F.coalesce((F.col("_bucket") == F.col("cut_bucket")) & (F.col("need") > 0), F.lit(False))
    none = F.lit(0).cast("long")
    plain = out.where(~cut).withColumn("_part", F.when((F.col("need") > 0) & (F.col("_bucket") < F.col("cut_bucket")), F.col("_size")).otherwise(none))
    alike = F.row_number().over(Window.partitionBy("_source", "_turn").orderBy("_id", *order))
    met = out.where(cut).withColumn("_n", alike)
    met = met.join(edge, F.col("_source").eqNullSafe(F.col("_e")) & (F.col("_turn") == F.col("_t")) & (F.col("_n") == F.col("_k")), "left").drop("_n", "_e", "_t", "_k")
    return plain.unionByName(met.withColumn("_part", F.coalesce("_part", none)))


def mixture(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken (whole repetitions times size, plus the part)."""
    sized, by_source, edge = plan(docs, **how)
    rows = sized.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "_bucket", "_turn")
    return _parts(rows, by_source, edge, []).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source").alias("source"), "source_size", "target", (F.col("whole") * F.col("_size") + F.col("_part")).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, one row for each whole repetition and one with the first words of a partly taken document."""
    _, by_source, edge = plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), *_placed(seed, id_col, text_col)
    )
    # Rows alike in id and text may differ in other columns: these tell which of them takes which part.
    out = _parts(packed, by_source, edge, [F.to_json(F.col("_row"))])
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("whole").cast("int")), F.when(F.col("_part") > 0, F.array(F.col("_part"))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_copy", F.explode(copies))
    text = F.when((F.col("_copy") < 0) | (F.col("_copy") == F.col("_size")), F.col(f"_row.`{text_col}`")).otherwise(F.array_join(F.slice(word_array(F.col(f"_row.`{text_col}`")), F.lit(1), F.col("_copy").cast("int")), " "))
    return out.select(*[text.alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
