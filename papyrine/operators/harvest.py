"""The harvest as one job: cached sections, full texts by any identifier, abstracts as fallback, gap sentences and counters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from papyrine.functions.text import cue_phrases, cue_sentences, open_section
from papyrine.operators.evidence import either
from papyrine.session import stored


@dataclass
class Harvest:
    """gaps: (paper, found_in, n, sentence); counts: one row a key; sections: rows (paper, section) to append to the cache; pmcids: (paper, pmcid) newly resolved."""

    gaps: DataFrame
    counts: DataFrame
    sections: DataFrame
    pmcids: DataFrame


def left(rows: DataFrame, key: Column, found: DataFrame, found_key: str, apart: str = "paper") -> DataFrame:
    """Left join by a text key. Rows without a key meet nothing; they go by `apart`, for by their null all of them, with their abstracts, would go to one task."""
    own = F.coalesce(F.concat(F.lit("k"), key), F.concat(F.lit("n"), F.coalesce(F.col(apart).cast("string"), F.lit(""))))
    return rows.join(found.withColumn("_key", F.concat(F.lit("k"), F.col(found_key))), own == F.col("_key"), "left").drop("_key", found_key)


def resolved_ids(papers: DataFrame, links: DataFrame) -> DataFrame:
    """papers with found: the pmcid of its PMID or, without a PMID, of its DOI. links: (pmid, doi, pmcid)."""
    by_pmid = links.where("pmid IS NOT NULL").groupBy(F.col("pmid").alias("_p")).agg(F.min("pmcid").alias("_by_pmid"))
    by_doi = links.where("doi IS NOT NULL").groupBy(F.lower("doi").alias("_d")).agg(F.min("pmcid").alias("_by_doi"))
    pmid, doi = either(F.col("pmid")), F.lower(either(F.col("doi")))
    met = left(left(papers, pmid, by_pmid, "_p"), F.when(pmid.isNull(), doi), by_doi, "_d")
    return met.withColumn("found", F.coalesce("_by_pmid", "_by_doi")).drop("_by_pmid", "_by_doi")


def harvest(papers: DataFrame, cache: DataFrame, links: DataFrame, fulltexts: DataFrame, key: str, again: bool = False, phrases: tuple[str, ...] | None = None, **section) -> Harvest:
    """papers: (paper, key, pmid, doi, pmcid, abstract); cache: (paper, section), null where a look found none; links: (pmid, doi, pmcid); fulltexts: (pmcid, xml).

    A cached paper is not looked up (with `again`, one cached without a section is). Others are, if they have any identifier, and what the
    look found, null included, goes to the cache. A paper without a section is read by its abstract, and its
    sentences are tagged so. counts tells apart papers that nobody could look up, those without open access and those whose
    full text has no such section.
    """
    known = cache.groupBy("paper").agg(F.max("section").alias("section"))
    known = (known.where(either(F.col("section")).isNotNull()) if again else known).withColumn("cached", F.lit(True))
    own = papers.select("paper", F.col(key).alias("key"), "pmid", "doi", either(F.col("pmcid")).alias("pmcid"), "abstract")
    state = own.join(known, "paper", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    todo = resolved_ids(state.where("NOT cached"), links)
    todo = todo.withColumn("asked", F.col("pmcid").isNull() & F.coalesce(either(F.col("pmid")), either(F.col("doi"))).isNotNull()).withColumn("own", F.col("pmcid"))
    todo = todo.withColumn("pmcid", F.coalesce("pmcid", F.when(F.col("asked"), F.col("found"))))
    texts = fulltexts.select(F.col("pmcid").alias("_id"), open_section(F.col("xml"), **section).alias("_section"))
    todo = left(todo, F.col("pmcid"), texts.where("_id IS NOT NULL").groupBy("_id").agg(F.max("_section").alias("_section")), "_id")
    todo = todo.select("paper", "key", "pmcid", "own", "abstract", F.col("_section").alias("section"), F.lit(False).alias("cached"), "asked", (F.col("own").isNotNull() | F.col("asked")).alias("looked"))
    done = state.where("cached").select("paper", "key", "pmcid", F.col("pmcid").alias("own"), "abstract", "section", "cached", F.lit(False).alias("asked"), F.lit(False).alias("looked"))
    rows = todo.unionByName(done)
    where = F.when(either(F.col("section")).isNotNull(), "discussion").when(either(F.col("abstract")).isNotNull(), "abstract")
    rows = stored(rows.withColumn("found_in", where), "harvest")
    text = F.when(F.col("found_in") == "discussion", F.col("section")).when(F.col("found_in") == "abstract", F.col("abstract"))
    found = cue_sentences(text, cue_phrases() if phrases is None else phrases)
    gaps = stored(rows.where("found_in IS NOT NULL").select("paper", "key", "found_in", F.posexplode(found).alias("n", "sentence")), "gaps")
    per = gaps.groupBy(F.col("key").alias("_key")).agg(F.count_if(F.col("found_in") == "discussion").alias("gaps_discussion"), F.count_if(F.col("found_in") == "abstract").alias("gaps_abstract"))
    is_new = ~F.col("cached")
    counts = rows.groupBy("key").agg(
        F.count("*").alias("n_papers"), F.count_if("asked").alias("n_resolved"), F.count_if(is_new & ~F.col("looked")).alias("n_without_identifier"),
        F.count_if(F.coalesce(F.col("found_in") == "discussion", F.lit(False))).alias("n_with_fulltext"), F.count_if(F.col("asked") & F.col("pmcid").isNull()).alias("n_no_open_access"),
        F.count_if(is_new & F.col("pmcid").isNotNull() & either(F.col("section")).isNull()).alias("n_fulltext_but_no_section"), F.count_if(F.coalesce(F.col("found_in") == "abstract", F.lit(False))).alias("n_from_abstract"),
    )
    counts = counts.join(per, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key").fillna(0, ["gaps_discussion", "gaps_abstract"])
    return Harvest(gaps.select("paper", "found_in", "n", "sentence"), counts.withColumnRenamed("key", key), rows.where("looked").select("paper", "section"), rows.where("asked AND pmcid IS NOT NULL").select("paper", "pmcid"))
