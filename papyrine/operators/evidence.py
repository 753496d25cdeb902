"""What a run covered and what it did not: harvests, verdicts and their limits, caveats, anchors, fields of ideas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from papyrine.functions.measures import rate
from papyrine.functions.text import one_space
from papyrine.operators.relational import latest, top

#: Verdict words that rule on a direction with what is stored for them, and those that say no ruling was made.
RULINGS = {"ALREADY DONE": "scooped", "PURSUED SINCE": "scooped"}
NO_RULING = ("TERM TOO RARE", "NO TERMS", "SINGLE GROUP", "CHECK FAILED")


def either(*names: Column) -> Column:
    """The first of several columns that holds text."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in names])


def harvested(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """papers: (paper, has_id, abstract); cache: (paper, section), null where one looked and found none. Adds looked, found_in and text: the section, else the abstract, tagged so."""
    known = cache.groupBy("paper").agg(F.max("section").alias("section")).withColumn("looked", F.lit(True))
    out = papers.join(known, "paper", "left").withColumn("looked", F.coalesce("looked", F.lit(False)))
    where = F.when(either(F.col("section")).isNotNull(), "discussion").when(either(F.col("abstract")).isNotNull(), "abstract")
    return out.withColumn("found_in", where).withColumn("text", F.when(F.col("found_in") == "discussion", F.col("section")).when(F.col("found_in") == "abstract", F.col("abstract"))).drop("section", "abstract")


def harvest_counts(found: DataFrame, key: str) -> DataFrame:
    """By key: papers, those with full text, looked up in vain, without any identifier, and read by their abstract only."""
    full = F.coalesce(F.col("found_in") == "discussion", F.lit(False))
    return found.groupBy(key).agg(
        F.count("*").alias("n_papers"), F.count_if(full).alias("n_with_fulltext"), F.count_if(F.col("looked") & ~full).alias("n_no_section"),
        F.count_if(~F.col("has_id") & ~F.col("looked")).alias("n_without_identifier"), F.count_if(F.coalesce(F.col("found_in") == "abstract", F.lit(False))).alias("n_from_abstract"),
    )


def to_fetch(papers: DataFrame, cache: DataFrame, again: bool = False) -> DataFrame:
    """Papers with an identifier that nobody looked up; with `again` also those where the look found nothing."""
    known = cache.where("section IS NOT NULL") if again else cache
    return papers.where("has_id").join(known.select("paper").distinct(), "paper", "left_anti")


def novelty(verdict: Column, zone: Column) -> Column:
    """The stored word for a ruling; an open question is adjacent or without prior art by its zone; null where nothing was ruled."""
    out = F.when((verdict == "STILL OPEN") & (zone == "ADJACENT"), "adjacent").when(verdict == "STILL OPEN", "no_prior_art")
    for said, stored in RULINGS.items():
        out = out.when(verdict == said, stored)
    return out


def limits(verdict: Column, zone: Column, why: Column, slots: Column, co_mentions: Column) -> Column:
    """What a reader must know before trusting the verdict, joined by spaced pipes; null if nothing."""
    return F.nullif(F.concat_ws(
        " | ", F.when(verdict.isin(*NO_RULING), F.concat(F.lit("no ruling: "), F.coalesce(why, verdict))), F.when(slots >= 3, "three or more slots: a weak not-done"),
        F.when(zone == "NEVER MEET", "concepts never met before the cutoff"), F.when((zone == "ADJACENT") & (verdict == "STILL OPEN"), "adjacent is no praise of the question"),
        F.when(co_mentions.isNotNull(), "co-mentions of the open subset only"),
    ), F.lit(""))


def as_list(column: Column, is_text: bool) -> Column:
    """A list that may have been stored as one bare text; null is empty."""
    one = F.when(column.isNull(), F.array().cast("array<string>")).otherwise(F.array(column)) if is_text else column
    return F.coalesce(one, F.array().cast("array<string>"))


def acquisition(graded: DataFrame) -> DataFrame:
    """graded: (idea, tier, missing, route, at, id). What the latest grading of each idea says is still to be had, copied."""
    is_text = dict(graded.dtypes)["missing"] == "string"
    return latest(graded, ["idea"], [F.col("at").desc(), F.col("id").desc()]).select("idea", "tier", as_list(F.col("missing"), is_text).alias("missing"), "route", "at")


def caveats(projects: DataFrame, harvests: DataFrame, graded: DataFrame, checks: DataFrame, rounds: DataFrame) -> DataFrame:
    """One row per project: the last finished harvest's coverage, how many graded ideas were never checked, the ideas whose last check found them done, and the last debate round.

    harvests: (project, at, id, n_papers, n_with_fulltext); graded: (project, idea); checks: (project, idea, verdict, at, id); rounds: (project, round_no, open).
    """
    newest = [F.col("at").desc(), F.col("id").desc()]
    read = latest(harvests, ["project"], newest).select("project", "n_papers", "n_with_fulltext", (F.col("n_papers") - F.col("n_with_fulltext")).alias("n_silent"))
    pool = graded.select("project", "idea").distinct().join(checks.select("project", "idea").distinct().withColumn("seen", F.lit(1)), ["project", "idea"], "left")
    pool = pool.groupBy("project").agg(F.count("*").alias("n_graded"), F.count_if(F.col("seen").isNull()).alias("n_unverified"))
    done = latest(checks, ["project", "idea"], newest).where("verdict = 'scooped'").groupBy("project").agg(F.count("*").alias("n_done"), F.array_sort(F.collect_list("idea")).alias("done"))
    last = rounds.groupBy("project").agg(F.max(F.struct("round_no", "open")).alias("r")).select("project", F.col("r.round_no").alias("n_rounds"), F.col("r.open").alias("n_open"))
    out = projects.select("project").join(read, "project", "left").join(pool, "project", "left").join(done, "project", "left").join(last, "project", "left")
    zero = {c: 0 for c in ("n_graded", "n_unverified", "n_done", "n_rounds")}
    return out.fillna(zero).withColumn("done", F.coalesce("done", F.array().cast(dict(out.dtypes)["done"])))


def query_repeat_rate(queries: DataFrame) -> DataFrame:
    """queries: (run, text, domain, at). By run the share of queries that were asked before, in any run, with the same words for the same domain."""
    first = queries.groupBy(F.lower(one_space(F.col("text"))).alias("k"), F.col("domain").alias("d")).agg(F.min("at").alias("first_at"))
    own = queries.withColumn("_k", F.lower(one_space(F.col("text"))))
    met = own.join(first, (F.col("_k") == F.col("k")) & F.col("domain").eqNullSafe(F.col("d")), "left")
    return met.groupBy("run").agg(F.count("*").alias("n_queries"), F.count_if(F.col("first_at") < F.col("at")).alias("n_repeated")).withColumn("query_repeat_rate", rate(F.col("n_repeated"), F.col("n_queries")))


def venue_tier(venue: Column, general: list[str], special: list[str]) -> Column:
    """2 for a venue that fits a general pattern, 1 for one of the domain's, else 0, without regard to case. A percent sign at an end of a pattern leaves that end open; all else in it is meant as it stands."""
    name = F.lower(F.trim(venue))

    def one(pattern: str) -> Column:
        core = F.lit(pattern.lower().removeprefix("%").removesuffix("%"))
        if pattern.startswith("%") and pattern.endswith("%"):
            return F.contains(name, core)
        if pattern.endswith("%"):
            return F.startswith(name, core)
        return F.endswith(name, core) if pattern.startswith("%") else name == core

    fits = lambda patterns: F.coalesce(F.greatest(F.lit(False), F.lit(False), *[one(p) for p in patterns]), F.lit(False)) & (name != "")
    return F.when(fits(general), 2).when(fits(special), 1).otherwise(0)


def filled(*columns: Column) -> Column:
    """How many of the columns hold text."""
    return sum((either(c).isNotNull().cast("int") for c in columns), F.lit(0))


def source_id(openalex: Column, source: Column, own: Column, name: str = "openalex") -> Column:
    """An id that belongs to the named source: its own column, else the record's id where the record comes from there."""
    return F.coalesce(openalex, F.when(source == name, own))


def side(kind: Column) -> Column:
    return F.when(kind == "anchor", "anchor").otherwise("idea")


def guarded(anchors: DataFrame) -> DataFrame:
    """Anchors with a title; an empty list of term groups is null, and so is a cutoff that is no year from 1800 to 2100."""
    year = F.col("cutoff").cast("string").try_cast("int")
    out = anchors.where(either(F.col("title")).isNotNull()).withColumn("title", F.trim("title")).withColumn("origin", F.coalesce(either(F.col("origin")), F.lit("local")))
    return out.withColumn("term_groups", F.when(F.size("term_groups") > 0, F.col("term_groups"))).withColumn("cutoff", F.when(year.between(1800, 2100), year))


def keyed(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Insert or update: rows are the same if they share origin and external id or, without one, the title. Of several new rows the last by `order` wins; old rows that no new one meets stay."""
    key = F.coalesce(F.concat(F.lit("x"), either(F.col("external_id").cast("string"))), F.concat(F.lit("t"), F.col("title")))
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).withColumn("_key", key)
    return top(both, ["origin", "_key"], [F.col("_new").desc(), F.col(order).desc()], 1).drop("_new", "_key", "rank")


def live(ideas: DataFrame, verdicts: DataFrame) -> DataFrame:
    """ideas: (idea, merged_into, ...); verdicts: (idea, verdict, at, id). Ideas not merged away whose last verdict, if any, is not that they are done."""
    last = latest(verdicts, ["idea"], [F.col("at").desc(), F.col("id").desc()]).select("idea", F.col("verdict").alias("last_verdict"))
    return ideas.where("merged_into IS NULL").join(last, "idea", "left").where(F.coalesce(F.col("last_verdict") != "scooped", F.lit(True)))


def undecided_first(pairs: DataFrame) -> DataFrame:
    """pairs: (verdict, score, a, b): those without a verdict, then by score, missing scores last."""
    return pairs.orderBy(F.col("verdict").isNotNull(), F.col("score").desc_nulls_last(), "a", "b")


def pending(runs: DataFrame, most: int = 1) -> DataFrame:
    """runs: (run, at, source, answered). The newest runs in which a source did not answer, with how many."""
    by_run = runs.groupBy("run").agg(F.count_if(~F.col("answered")).alias("n_open"), F.max("at").alias("at"))
    return by_run.where("n_open > 0").orderBy(F.col("at").desc(), F.col("run").desc()).limit(most)


def concept_history(history: DataFrame) -> DataFrame:
    """history: (project, versions array<struct<at, concepts array<struct<input, descriptor, expanded>>>>). The concepts searched, newest version first, with the version they last stood in and in how many they stood."""
    rows = history.select("project", F.posexplode("versions").alias("version", "v")).select("project", "version", "v.at", F.explode("v.concepts").alias("c")).select("project", "version", "at", "c.*")
    return rows.groupBy("project", "input").agg(F.max_by("descriptor", "version").alias("descriptor"), F.max_by("expanded", "version").alias("expanded"), F.max("version").alias("last_version"), F.min("at").alias("since"), F.count_distinct("version").alias("n_versions"))


def tournament(entries: DataFrame, games: DataFrame) -> DataFrame:
    """entries: (tournament, id, kind, elo); games: (tournament, l, r, winner). Read model: the place of each entry, its side, games, wins, and how many games are undecided."""
    each = games.select("tournament", F.col("l").alias("id"), (F.col("winner") == "l").alias("won"), F.col("winner").isNull().alias("open")).unionByName(games.select("tournament", F.col("r").alias("id"), (F.col("winner") == "r").alias("won"), F.col("winner").isNull().alias("open")))
    counts = each.groupBy("tournament", "id").agg(F.count("*").alias("n_games"), F.count_if("won").alias("n_won"), F.count_if("open").alias("n_open"))
    place = F.row_number().over(Window.partitionBy("tournament").orderBy(F.col("elo").desc_nulls_last(), "id"))
    out = entries.join(counts, ["tournament", "id"], "left").fillna(0, ["n_games", "n_won", "n_open"])
    return out.withColumn("side", side(F.col("kind"))).withColumn("place", place).drop("kind")


def parked(states: DataFrame) -> DataFrame:
    """states: (project, state). By project how many stages are parked and how many done."""
    return states.groupBy("project").agg(F.count_if(F.col("state") == "parked").alias("n_parked"), F.count_if(F.col("state") == "done").alias("n_done"), F.count("*").alias("n_stages"))
