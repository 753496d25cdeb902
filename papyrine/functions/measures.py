"""Numbers: similarities, ratings, prices, rates. Rates are null where the denominator is zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Dollars a million tokens are multiplied by these.
CACHE_READ, CACHE_WRITE, BATCH = 0.1, 1.25, 0.5


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(F.when(whole > 0, part / whole), digits)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def drift(original: Column, current: Column, digits: int = 4) -> Column:
    return F.round(1 - jaccard(original, current), digits)


def tfidf(tf: Column, df: Column, n: Column) -> Column:
    return (1 + F.log(tf)) * F.log((n + 1) / (df + 1))


def blend(cosine: Column, jaccard_: Column) -> Column:
    return F.round(0.7 * cosine + 0.3 * jaccard_, 3)


def expectation(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (other - own) / 400))


def price(rate_in: Column, rate_out: Column, tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, batch: Column) -> Column:
    """Dollars of a call; an unknown price is an error, never free."""
    count = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(12,0)")
    exact = lambda x, kind: F.lit(str(x)).cast(kind)
    r_in, r_out = rate_in.cast("decimal(8,4)"), rate_out.cast("decimal(8,4)")
    usd = count(tokens_in) * r_in + count(tokens_out) * r_out + count(cache_read) * r_in * exact(CACHE_READ, "decimal(3,2)") + count(cache_write) * r_in * exact(CACHE_WRITE, "decimal(3,2)")
    usd = usd * F.when(batch, exact(BATCH, "decimal(2,1)")).otherwise(exact(1.0, "decimal(2,1)")) * exact("0.000001", "decimal(7,6)")  # decimals: halves round the same everywhere
    return F.when(rate_in.isNull(), F.raise_error("no price is known for this model").cast("double")).otherwise(F.round(usd, 6).cast("double"))


def width_of_crossing(most: int, concepts: Column) -> Column:
    """Variants a side of a crossing of k concepts takes so that about `most` queries come out."""
    return F.greatest(F.lit(2), (F.bround(F.pow(F.lit(float(most)), 1 / concepts), 0) + 1).cast("int"))
