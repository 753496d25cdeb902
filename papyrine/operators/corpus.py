"""Corpus integration: one record per work across sources, relevance order, run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from papyrine.functions.measures import rate
from papyrine.operators.triage import clusters


def union_all(batches: list[DataFrame]) -> DataFrame:
    """Batches of sources one under another, by name; a missing column is null."""
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def merged(records: DataFrame) -> DataFrame:
    """records: (rec long, source, src_rank, doi, title_key, title, citations, year). One row per work.

    Works are the components of records that share a DOI, or a title where their DOIs do not conflict. The
    representative is the record of least (rank, source, rec). Keys pair a record with the first of its key, so a key that
    very many records share costs one edge each.
    """
    with_doi = records.where("doi IS NOT NULL")
    by_doi = with_doi.join(with_doi.groupBy("doi").agg(F.min("rec").alias("b")), "doi").select(F.col("rec").alias("a"), "b")
    keys = records.where("title_key IS NOT NULL").groupBy("title_key").agg(F.min("rec").alias("b"), F.count_distinct("doi").alias("dois")).where("dois <= 1")
    by_title = records.join(keys, "title_key").select(F.col("rec").alias("a"), "b")
    root = clusters(by_doi.unionByName(by_title), "works")
    all_ = records.join(root, records.rec == root.node, "left").withColumn("work", F.coalesce("root", "rec"))
    order = F.struct("src_rank", "source", "rec")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("src_rank", "source", "rec", F.col(c).alias("v"))))["v"].alias(c)
    return all_.groupBy("work").agg(
        F.min_by("source", order).alias("source"), F.min("src_rank").alias("rank"), first("doi"), first("title"), first("year"),
        F.max(F.coalesce("citations", F.lit(0))).alias("citations"), F.array_sort(F.collect_set("source")).alias("also_in"), F.count("*").alias("n_records"),
    )


def by_relevance(works: DataFrame) -> DataFrame:
    """Best rank first, then found by more sources, then by number."""
    return works.orderBy("rank", F.size("also_in").desc(), "work")


def run_metrics(hits: DataFrame) -> DataFrame:
    """hits: (run, query, paper, rank, is_reused). Per run: reuse rate, mean overlap of papers within the run."""
    per = hits.groupBy("run").agg(F.count("*").alias("n_hits"), F.count_distinct("paper").alias("n_papers"), F.count_distinct(F.when(F.col("is_reused"), F.col("paper"))).alias("n_reused"), F.count_distinct("query").alias("n_queries"))
    return per.withColumn("paper_reuse_rate", rate(F.col("n_reused"), F.col("n_papers"))).withColumn("within_run_overlap", rate(F.col("n_hits") - F.col("n_papers"), F.col("n_hits")))


def repeats(queries: DataFrame) -> DataFrame:
    """queries: (id, project, topic, source, at). Those asked before: an earlier one of the project with the same topic and the same source, null matching null."""
    a, b = queries.alias("a"), queries.alias("b")
    return a.join(b, (F.col("a.project") == F.col("b.project")) & (F.col("a.topic") == F.col("b.topic")) & F.col("a.source").eqNullSafe(F.col("b.source")) & ((F.col("b.at") < F.col("a.at")) | ((F.col("b.at") == F.col("a.at")) & (F.col("b.id") < F.col("a.id")))), "left_semi")


def least_rank(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query", "paper").agg(F.min("rank").alias("rank"))
