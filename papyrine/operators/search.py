"""Search over several sources, concept lookup and expansion, works by any identifier, citation roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from papyrine.functions.text import label_score, label_tokens, squashed
from papyrine.operators.corpus import by_relevance, merged, union_all
from papyrine.operators.relational import top
from papyrine.session import stored
from papyrine.sources import paged


#: The record that sources give: see corpus.merged; place orders the records of a source.
RECORD = "rec long, place long, doi string, title_key string, title string, citations long, year int"


def asked(spark: SparkSession, sources: dict[str, Callable[[], DataFrame] | None]) -> tuple[DataFrame | None, DataFrame]:
    """(records, attempts). A source is a function that gives its records; each is read once, into the shared folder, so one that fails while it is read is passed over like one that is unknown (None).

    records: those of the sources that answered, null if none did. attempts: (source, answered, error, n_records), one row a source asked.
    """
    batches, attempts = [], []
    for name, read in sources.items():
        try:
            if read is None:
                raise LookupError("unknown source")
            batch = stored(in_source_rank(read().withColumn("source", F.lit(name))), "source")
            attempts.append((name, True, None, batch.count()))
            batches.append(batch)
        except Exception as error:  # one source that is down must not end the search; what it said is kept
            said = str(error).strip().splitlines() or [""]
            attempts.append((name, False, f"{type(error).__name__}: {said[0]}"[:400], 0))
    tried = spark.createDataFrame(attempts, "source string, answered boolean, error string, n_records long")
    return (union_all(batches) if batches else None), tried


def works_of(spark: SparkSession, records: DataFrame | None, sort: str = "relevance") -> DataFrame:
    """The records of all sources as works, in order."""
    if records is None:
        return spark.createDataFrame([], "work long, source string, rank int, doi string, title string, year int, citations long, also_in array<string>, n_records long")
    return in_order(merged(records), sort)


def search(spark: SparkSession, sources: dict[str, Callable[[], DataFrame] | None], sort: str = "relevance") -> tuple[DataFrame, DataFrame]:
    """(works, attempts) of asked and works_of."""
    records, attempts = asked(spark, sources)
    return works_of(spark, records, sort), attempts


def paged_search(pages: DataFrame, item: str, record: Callable[[DataFrame], DataFrame], sort: str = "relevance") -> tuple[DataFrame, DataFrame]:
    """(works, attempts) of pages (see sources.paged): the works of the sources that answered to the end, and how each source fared. record turns items into records.

    The pages are stored first, so that every source is asked once.
    """
    met = stored(pages, "pages")
    tried = paged.outcomes(met)
    good = met.join(tried.where("answered").select("source"), "source", "left_semi")
    records = in_source_rank(record(paged.items(good, item)))
    counts = records.groupBy("source").agg(F.count("*").alias("n_records"))
    return works_of(pages.sparkSession, records, sort), tried.join(counts, "source", "left").fillna(0, ["n_records"])


def in_source_rank(records: DataFrame) -> DataFrame:
    """src_rank from 0: the place of a record within its source."""
    return records.withColumn("src_rank", (F.row_number().over(Window.partitionBy("source").orderBy("place", "rec")) - 1).cast("int"))


def in_order(works: DataFrame, sort: str = "relevance") -> DataFrame:
    """By relevance, or most cited first, or newest first; missing numbers last."""
    if sort == "citations":
        return works.orderBy(F.col("citations").desc_nulls_last(), "work")
    if sort == "year":
        return works.orderBy(F.col("year").desc_nulls_last(), "work")
    return by_relevance(works)


def reversed_words(term: Column) -> Column:
    """A term of two to four words back to front, else null."""
    words = F.split(F.trim(F.regexp_replace(term, r"\s+", " ")), " ")
    return F.when(F.size(words).between(2, 4), F.array_join(F.reverse(words), " "))


def lookup(terms: DataFrame, entries: DataFrame, labels: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """terms: (term); entries: (ui, entry); labels: (ui, label); synonyms: (term, name). Rows (term, ui, label, via, score).

    An entry term that equals the term scores 100. Labels that contain the term, or its words back to front, as whole words score by
    overlap. Terms that found nothing are matched without punctuation; those that still found nothing by the names that synonyms
    propose, which go through the same first two lookups, one after another until one answers. A descriptor stands once a term, with its best score.
    """
    found = _direct(terms.select("term", F.col("term").alias("asked")), entries, labels)
    rest = terms.join(found.select("term").distinct(), "term", "left_anti")
    plain = rest.join(labels, squashed(F.col("term"), None) == squashed(F.col("label"), None)).select("term", "ui", "label", F.lit("normalised").alias("via"), label_score(label_tokens(F.col("term")), label_tokens(F.col("label"))).cast("double").alias("score"))
    out = found.unionByName(plain)
    if synonyms is not None:
        rest = rest.join(plain.select("term").distinct(), "term", "left_anti")
        named = rest.join(proposals(synonyms), "term").select("term", F.col("name").alias("asked"), "place")
        hits = _direct(named.select(F.struct("term", "place").alias("term"), "asked"), entries, labels).select("term.term", "term.place", "ui", "label", F.lit("synonym").alias("via"), "score")
        first = hits.groupBy("term").agg(F.min("place").alias("place"))
        out = out.unionByName(hits.join(first, ["term", "place"]).drop("place"))
    return top(out, ["term", "ui"], [F.col("score").desc(), F.col("via")], 1).drop("rank")


#: Fixed value: what a service of synonyms says where it has none.
NO_SYNONYM = "NO RESULTS"


def proposals(synonyms: DataFrame, most: int = 5) -> DataFrame:
    """synonyms: (term, name) and place, the order they were proposed in, without which they go by name. The first `most` different names of a term, without the row that says there are none: (term, name, place)."""
    rows = synonyms if "place" in synonyms.columns else synonyms.withColumn("place", F.dense_rank().over(Window.partitionBy("term").orderBy("name")))
    rows = rows.where((F.trim("name") != "") & (F.upper(F.trim("name")) != NO_SYNONYM))
    once = top(rows, ["term", "name"], [F.col("place")], 1).drop("rank")
    return top(once, ["term"], [F.col("place"), F.col("name")], most).select("term", "name", F.col("rank").alias("place"))


def _direct(asked: DataFrame, entries: DataFrame, labels: DataFrame) -> DataFrame:
    exact = asked.join(entries, F.lower("asked") == F.lower("entry")).join(labels, "ui").select("term", "ui", "label", F.lit("entry").alias("via"), F.lit(100.0).alias("score"))
    ways = asked.withColumn("way", F.explode(F.filter(F.array("asked", reversed_words(F.col("asked"))), lambda x: x.isNotNull())))
    # A label that contains the way holds its first word: an equi-join by words, then the whole-word test.
    word = lambda c: F.explode(F.array_distinct(F.split(F.lower(c), "[^a-z0-9]+"))).alias("w")
    ways = ways.select("term", "asked", F.lower("way").alias("way"), F.element_at(F.filter(F.split(F.lower("way"), "[^a-z0-9]+"), lambda x: x != ""), 1).alias("w"))
    met = ways.join(labels.select("ui", "label", word(F.col("label"))), "w").where(F.concat(F.lit(" "), F.regexp_replace(F.lower("label"), "[^a-z0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.regexp_replace("way", "[^a-z0-9]+", " "), F.lit(" "))))
    part = met.select("term", "ui", "label", F.lit("label").alias("via"), label_score(label_tokens(F.col("asked")), label_tokens(F.col("label"))).cast("double").alias("score"))
    return exact.unionByName(part).distinct()


def described(ids: DataFrame, paths: DataFrame, broader: DataFrame, notes: DataFrame) -> DataFrame:
    """ids: (ui) with what the three optional tables know: sets of paths and of broader labels, empty where there are none, and a note."""
    sets = lambda df, c, name: df.groupBy("ui").agg(F.array_sort(F.collect_set(c)).alias(name))
    out = ids.join(sets(paths, "path", "paths"), "ui", "left").join(sets(broader, "label", "broader"), "ui", "left").join(notes.groupBy("ui").agg(F.min("note").alias("note")), "ui", "left")
    empty = F.array().cast("array<string>")
    return out.select("ui", F.coalesce("paths", empty).alias("paths"), F.coalesce("broader", empty).alias("broader"), "note")


def expansion(terms: DataFrame, found: DataFrame, relatives: DataFrame, per_concept: int = 10) -> tuple[DataFrame, DataFrame]:
    """terms: (term); found: (term, ui, label, place), best first from 1; relatives: (ui, relative, label, relation, place). (concepts, alternatives).

    The head of a term is its best descriptor; a term without one stands for itself, not expanded. Alternatives are the head's relatives
    first, then the other descriptors of the term as label matches, no descriptor twice, per_concept - 1 in all.
    """
    head = found.where("place = 1").select("term", F.col("ui").alias("head"), F.col("label").alias("descriptor"))
    concepts = terms.where(F.trim("term") != "").select(F.trim("term").alias("term")).distinct().join(head, "term", "left")
    concepts = concepts.select("term", F.col("head").isNotNull().alias("expanded"), "descriptor", "head")
    near = head.select("term", "head").join(relatives, F.col("head") == F.col("ui")).select("term", "head", F.col("relative").alias("ui"), "label", "relation", F.lit(0).alias("kind"), F.col("place").cast("long").alias("place"))
    rest = found.where("place > 1").join(head.select("term", "head"), "term").select("term", "head", "ui", "label", F.lit("label_match").alias("relation"), F.lit(1).alias("kind"), F.col("place").cast("long").alias("place"))
    once = top(near.unionByName(rest).where("ui <> head"), ["term", "ui"], [F.col("kind"), F.col("place"), F.col("relation")], 1).drop("rank")
    kept = top(once, ["term"], [F.col("kind"), F.col("place"), F.col("ui")], per_concept - 1)
    return concepts, kept.select("term", "ui", "label", "relation", "rank")


def degraded(concepts: DataFrame) -> DataFrame:
    """One row: whether any concept could not be expanded, how many, and which."""
    open_ = F.when(~F.col("expanded"), F.col("term"))
    return concepts.agg(F.coalesce(F.bool_or(~F.col("expanded")), F.lit(False)).alias("degraded"), F.count(open_).alias("n"), F.array_sort(F.collect_set(open_)).alias("unexpanded"))


def resolved(asked: DataFrame, works: DataFrame) -> DataFrame:
    """asked: (q); works: (work, doi, id, title_key, citations). The work of each question by DOI, else by id, else the most cited by title; null if none."""
    by_doi = works.where("doi IS NOT NULL").groupBy(F.lower("doi").alias("k")).agg(F.min("work").alias("by_doi"))
    by_id = works.where("id IS NOT NULL").groupBy(F.lower("id").alias("k")).agg(F.min("work").alias("by_id"))
    by_title = works.where("title_key IS NOT NULL").groupBy(F.col("title_key").alias("k")).agg(F.max_by("work", F.struct(F.coalesce("citations", F.lit(0)), -F.col("work"))).alias("by_title"))
    q = asked.select("q", F.lower("q").alias("_q"), squashed(F.col("q"), None).alias("_t")).distinct()
    out = q.join(by_doi, q._q == by_doi.k, "left").drop("k").join(by_id, F.col("_q") == by_id.k, "left").drop("k").join(by_title, F.col("_t") == by_title.k, "left")
    return out.select("q", F.coalesce("by_doi", "by_id", "by_title").alias("work"))


def related(links: DataFrame, seeds: DataFrame, limit: int = 20) -> DataFrame:
    """links: (a, b, score); seeds: (seed). The nearest of each seed, itself left out."""
    return top(links.join(seeds, links.a == seeds.seed).where("a <> b"), ["seed"], [F.col("score").desc(), F.col("b")], limit).select("seed", F.col("b").alias("work"), "score", "rank")


def topic_tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of three characters or more that begin with a letter, without the stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z][a-z0-9-]{2,})"), 1))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def overlap(topic: Column, own: Column) -> Column:
    """Share of the topic's tokens that stand among one's own."""
    return F.when(F.size(topic) > 0, F.round(F.size(F.array_intersect(topic, own)) / F.size(topic), 3)).otherwise(F.lit(0.0))


def role_signals(citations: Column, year: Column, seed_year: Column, topic: Column, own: Column) -> Column:
    """How much a work looks like the ground, the baseline and the topic of a later one: citations up to a cap, weighted by how long before it appeared, and shared topic words."""
    known = lambda y: F.nullif(y, F.lit(0))
    n, gap = F.coalesce(citations, F.lit(0)), F.coalesce(known(seed_year) - known(year), F.lit(0))
    weighed = lambda cap, fits, less: F.round(F.least(n / cap, F.lit(1.0)) * F.when(fits, 1.0).otherwise(less), 3)
    return F.struct(weighed(1000, gap >= 5, 0.6).alias("foundational"), weighed(300, (gap > 0) & (gap <= 5), 0.5).alias("baseline_like"), overlap(topic, own).alias("same_topic"))


def neighbours(edges: DataFrame, works: DataFrame, per_step: int = 6, milestone: int = 1000) -> DataFrame:
    """edges: (src, dst) cites; works: (work, citations, year, tokens). For every work the best works it cites (by its strongest role) and that cite it (by topic, then citations).

    (seed, way, work, score, rank, stops): stops marks a work of `milestone` citations, at which a walk ends.
    """
    seed = works.select(F.col("work").alias("seed"), F.col("year").alias("seed_year"), F.col("tokens").alias("topic"))
    pairs = edges.select("src", "dst").distinct().where("src <> dst")
    back = pairs.join(seed, pairs.src == seed.seed).join(works, F.col("dst") == works.work)
    roles = role_signals(F.col("citations"), F.col("year"), F.col("seed_year"), F.col("topic"), F.col("tokens"))
    back = back.withColumn("r", roles).select("seed", F.lit("backward").alias("way"), "work", F.greatest("r.foundational", "r.baseline_like", "r.same_topic").alias("score"), "citations")
    onward = pairs.join(seed, pairs.dst == seed.seed).join(works, F.col("src") == works.work)
    onward = onward.select("seed", F.lit("forward").alias("way"), "work", overlap(F.col("topic"), F.col("tokens")).alias("score"), "citations")
    later = F.when(F.col("way") == "forward", F.coalesce("citations", F.lit(0))).otherwise(0)
    kept = top(back.unionByName(onward), ["seed", "way"], [F.col("score").desc(), later.desc(), F.col("work")], per_step)
    return kept.select("seed", "way", "work", "score", "rank", (F.coalesce("citations", F.lit(0)) >= milestone).alias("stops"))


def chains(edges: DataFrame, works: DataFrame, seeds: DataFrame, depth: int, per_step: int = 6, milestone: int = 1000, topic: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, ends). From each seed a chain of works, each round one step on: the best works the present one cites (by its strongest role) and
    that cite it (by topic, then citations; none that the chain went through). The best citing work is the next one, unless it is a milestone, which ends the chain.

    edges: (src, dst) cites; works: (work, citations, year, tokens); seeds: (work); topic: tokens for all, else each present work's own. The state of a
    round is one row a chain and is stored with the round's rows, so lost executors cost one round.
    rows: (chain, step, work, way, neighbour, score, rank, is_milestone); ends: (chain, steps, why).
    """
    pairs = edges.select("src", "dst").distinct().where("src <> dst")
    info = works.select(F.col("work").alias("neighbour"), "citations", F.col("year").alias("_year"), F.col("tokens").alias("_tokens"))
    heads = seeds.select(F.col("work").alias("chain"), "work").distinct()
    seen, rounds, ends = heads, [], []
    for step in range(depth):
        own = heads.join(works.select("work", F.col("year").alias("seed_year"), (F.col("tokens") if topic is None else topic).alias("topic")), "work")
        back = own.join(pairs, own.work == pairs.src).select("chain", "work", "seed_year", "topic", F.col("dst").alias("neighbour")).join(info, "neighbour")
        roles = role_signals(F.col("citations"), F.col("_year"), F.col("seed_year"), F.col("topic"), F.col("_tokens"))
        back = back.withColumn("r", roles).select("chain", "work", F.lit("backward").alias("way"), "neighbour", F.greatest("r.foundational", "r.baseline_like", "r.same_topic").alias("score"), "citations")
        onward = own.join(pairs, own.work == pairs.dst).select("chain", "work", "topic", F.col("src").alias("neighbour"))
        onward = onward.join(seen.select("chain", F.col("work").alias("neighbour")), ["chain", "neighbour"], "left_anti").join(info, "neighbour")
        onward = onward.select("chain", "work", F.lit("forward").alias("way"), "neighbour", overlap(F.col("topic"), F.col("_tokens")).alias("score"), "citations")
        later = F.when(F.col("way") == "forward", F.coalesce("citations", F.lit(0))).otherwise(0)
        kept = top(back.unionByName(onward), ["chain", "way"], [F.col("score").desc(), later.desc(), F.col("neighbour")], per_step)
        is_big = F.coalesce("citations", F.lit(0)) >= milestone
        kept = stored(kept.select("chain", F.lit(step).alias("step"), "work", "way", "neighbour", "score", "rank", is_big.alias("is_milestone")), "chain")
        rounds.append(kept)
        first = kept.where("way = 'forward' AND rank = 1").select("chain", F.col("neighbour").alias("_next"), "is_milestone")
        state = heads.select("chain").join(first, "chain", "left")
        last = F.lit(step + 1 == depth)
        why = F.when(F.col("_next").isNull(), "nothing onward").when(last, "depth").when(F.col("is_milestone"), "milestone")
        state = stored(state.withColumn("why", why), "chainstate")
        ends.append(state.where("why IS NOT NULL").select("chain", F.lit(step + 1).alias("steps"), "why"))
        heads = state.where("why IS NULL").select("chain", F.col("_next").alias("work"))
        seen = seen.unionByName(heads)
        if step + 1 < depth and heads.isEmpty():
            break
    return union_all(rounds), union_all(ends)
