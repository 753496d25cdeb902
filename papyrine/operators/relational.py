"""Read-model operators: latest per key, upserts, semi and anti joins, counts, filters, validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def where_all(df: DataFrame, **wanted) -> DataFrame:
    """Conjunction of the filters that are given; a list means membership, None means no filter."""
    tests = [F.col(c).isin(v) if isinstance(v, (list, tuple)) else F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def in_years(year: Column, lo: int | None, hi: int | None) -> Column:
    """Open-ended window; a null year passes, as where the source itself cannot filter."""
    return year.isNull() | year.between(1800 if lo is None else lo, 3000 if hi is None else hi)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in the given order (end it with a unique column); planned as a window group limit."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """The next version of a table. policy by column: incoming, existing or filled (the incoming one unless null or empty). was_new tells rows the old table lacked."""
    a, b = old.alias("a"), new.alias("b")
    met = a.join(b, reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]), "full")
    pick = {"incoming": lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")), "existing": lambda c: F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")), "filled": lambda c: F.coalesce(F.nullif(F.col(f"b.{c}"), F.lit("")), F.col(f"a.{c}"))}
    return met.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], *[pick[p](c).alias(c) for c, p in policy.items()], F.col(f"a.{keys[0]}").isNull().alias("was_new"))


def next_version(history: DataFrame, key: str, version: str, incoming: DataFrame, content: str) -> DataFrame:
    """Rows to append: those whose content is not the latest version's, numbered on."""
    last = latest(history, [key], [F.col(version).desc()]).select(F.col(key).alias("_k"), F.col(version).alias("_v"), F.sha2(content, 256).alias("_h"))
    met = incoming.join(last, F.col(key) == F.col("_k"), "left").where(F.col("_h").isNull() | (F.col("_h") != F.sha2(content, 256)))
    return met.withColumn(version, F.coalesce(F.col("_v"), F.lit(0)) + 1).drop("_k", "_v", "_h")


def counted(left: DataFrame, right: DataFrame, on: str, counts: dict[str, Column]) -> DataFrame:
    """Correlated counts: right is summed up by key first, keys without rows count 0."""
    sums = right.groupBy(on).agg(*[c.alias(n) for n, c in counts.items()])
    return left.join(sums, on, "left").fillna(0, list(counts))


def vetted(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Adds why: the first rule (message, SQL condition of a bad row) that a row breaks, or null."""
    tests = [F.when(F.expr(bad), F.lit(message)) for message, bad in rules]
    return df.withColumn("why", F.coalesce(*tests))


def cited(claims: DataFrame, pool: DataFrame) -> DataFrame:
    """Look claims up by DOI, then by PMID; conflict where both hit and differ."""
    by_doi = pool.where("doi IS NOT NULL").groupBy(F.lower("doi").alias("_d")).agg(F.min("paper").alias("by_doi"))
    by_pmid = pool.where("pmid IS NOT NULL").groupBy(F.col("pmid").alias("_p")).agg(F.min("paper").alias("by_pmid"))
    met = claims.join(by_doi, F.lower("doi") == F.col("_d"), "left").join(by_pmid, F.col("pmid") == F.col("_p"), "left")
    state = F.when(F.col("by_doi") != F.col("by_pmid"), "conflict").when(F.coalesce("by_doi", "by_pmid").isNotNull(), "verified").otherwise("unknown")
    return met.withColumn("state", state).withColumn("paper", F.coalesce("by_doi", "by_pmid")).drop("_d", "_p")


def drifted(history: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows with before and changed: whether a key's value differs from its previous version's; a key that is new has not changed."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    return history.withColumn("before", before).withColumn("changed", F.coalesce(F.col("before") != F.col(value), F.lit(False)))


def claim(queue: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The n rows that wait longest. That no two workers claim one is for a lock outside."""
    return queue.orderBy(*order).limit(n)


def lacking(keys: Column, required: tuple[str, ...]) -> Column:
    """Required keys that are not among the keys."""
    return F.array_except(F.array(*map(F.lit, required)), keys)


def variants(synonyms: DataFrame, most: int) -> DataFrame:
    """synonyms: (concept, label tokens l, term, term tokens t). Of each concept the terms that share most words with its label, shorter and then alphabetical first."""
    order = [F.size(F.array_intersect("t", "l")).desc(), F.length("term"), F.col("term")]
    return top(synonyms, ["concept"], order, most)
