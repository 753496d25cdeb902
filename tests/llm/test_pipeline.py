"""The pipeline: stages in order, columns kept, decisions in effect."""

from pyspark.sql import functions as F

import corpus_pipeline
from papyrine.llm.queries import queries
from papyrine.session import stored
from tests.conftest import DATA


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DATA))
        sizes.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3]
    assert sizes[1] > 0.8 * sizes[0]
    assert corpus_pipeline.run(spark, DATA).count() == sizes[-1]


def test_awkward_and_empty_tables(docs, none):
    """Nulls, empty and repeated rows, clashing names: every stage keeps the columns, drops no more than it may, and takes an empty table."""
    clash = docs.withColumn("_row", F.lit(1)).withColumn("body", F.lit("b")).withColumn("_d", F.lit(2)).withColumn("a.b", F.lit(3))
    for frame in (clash, none):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, now = now, stored(stage(frame.sparkSession, now, DATA))
            assert now.columns == frame.columns, name
            assert name != "line dedup" or now.count() == before.count()
        packed = corpus_pipeline.STAGES[-1][1](frame.sparkSession, now, DATA)
        assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").isEmpty()
        assert (packed.count() > 0) == (frame is clash)


def test_registered():
    import __spark_entry__

    assert set(queries()) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries()} == {f"op{k}" for k in range(1, 14)}
