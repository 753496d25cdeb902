"""SimHash near-duplicates through vantage-point trees.

Fingerprints are 64-bit majorities over the XXH64 hashes of word shingles. Distinct fingerprints are
dealt into shards by a vantage-point tree whose depth follows their number and whose nodes are fitted on a sample of
PER_LEAF fingerprints a leaf, at most 2 ** 20 (8 MB). Every level deals some fingerprints to both sides, so the tree stays flat: up to 2 ** FLAT
leaves of any size over LEAF, and more only when a leaf would hold over WIDE fingerprints (2 MB); shards split further in memory. A node sends a
fingerprint nearer to its vantage point than the threshold left, others right. By the triangle bound a
pair within `radius` that a node parts has its left member within `radius` below the threshold, so only
those boundary members are also queried against the right side: every linked pair meets in some shard,
exactly. A shard too large for blockwise comparison is split by further vantage points in the same
way, and one that does not split (a dense cluster) looks up all values within the radius instead, so
no shard costs the square of its size. A shard returns a spanning forest (each fingerprint with the
smallest of its local component), never all its pairs; components over all shards are then joined by
star contraction.

Defined cases: null, empty and blank texts have fingerprint zero, which is linked like any other; a text
with fewer words than a shingle has one feature, the whole sequence; equal fingerprints are always one
component, so repeated rows keep their own rows and share it; an empty table gives no rows; columns
other than the id and the text are ignored by `near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from papyrine.llm.common import BLANKS, components, map_batches
from papyrine.session import dropped, reachable, stored

PER_LEAF, DEPTH, LEAF, BLOCK, DENSE = 64, 14, 4_096, 256, 65_536
FLAT, WIDE = 6, 1 << 18


def shingle_hashes(text: str | None, width: int, seed: int, lower: bool = True) -> np.ndarray:
    """XXH64 of every run of `width` words, joined by single spaces."""
    import xxhash

    raw = (text or "").encode()
    words = (raw.lower() if lower else raw).split()  # bytes: A-Z only, ASCII blanks only
    if not words:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    if len(words) <= width:
        return np.array([hashed(joined, seed)], np.uint64)
    starts = [0, *(e + 1 for e in ends[: len(words) - width])]
    return np.array([hashed(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=True)], np.uint64)


def bit_counts(hashes: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """How many hashes have each bit set, highest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), at_once):
        total += np.unpackbits(hashes[at : at + at_once].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return total


def majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    return int.from_bytes(np.packbits(bit_counts(hashes) * 2 > len(hashes)).tobytes())


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp the 64 bits as a signed long."""

    def work(batch: pa.RecordBatch) -> dict:
        prints = [majority(shingle_hashes(t, width, seed)) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(prints, np.uint64).view(np.int64))}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, fp long", "text")


# --- vantage-point trees ----------------------------------------------------------------------


def vantage(sample: np.ndarray, rng: np.random.Generator, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and threshold, among a few tried, that leave least of the larger side with its boundary."""
    best = None
    for v in sample[rng.integers(0, len(sample), 12)]:
        away = np.bincount(np.bitwise_count(sample ^ v), minlength=65)
        left = np.cumsum(away)  # left[t - 1]: nearer than t
        for t in range(1, 65):
            right = len(sample) - left[t - 1] + left[t - 1] - (left[t - 1 - radius] if t - 1 - radius >= 0 else 0)
            worse = max(left[t - 1], right)
            if best is None or worse + right + left[t - 1] < best[0]:
                best = (worse + right + left[t - 1], v, t, worse)
    return None if best is None or best[3] > 0.9 * len(sample) else (best[1], best[2])


def grow(sample: np.ndarray, depth: int, radius: int, seed: int = 7) -> list[tuple[int, int]]:
    """Nodes in heap order: (vantage point, threshold), threshold 0 for a leaf."""
    rng = np.random.default_rng(seed)
    nodes, held = [(0, 0)] * (2 << depth), {1: sample}
    for i in range(1, 1 << depth):
        part = held.pop(i, None)
        if part is None or len(part) < 64 or (found := vantage(part, rng, radius)) is None:
            continue
        v, t = found
        nodes[i] = (int(v), t)
        away = np.bitwise_count(part ^ v)
        held[2 * i], held[2 * i + 1] = part[away < t], part[away >= t - radius]
    return nodes


def shards(prints: np.ndarray, nodes: list[tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the fingerprint, leaf) for every leaf it belongs to or bounds on."""
    done, todo = [], [(1, np.arange(len(prints)))]
    while todo:
        i, own = todo.pop()
        if not len(own):
            continue
        v, t = nodes[i]
        if not t:
            done.append((own, np.full(len(own), i)))
            continue
        away = np.bitwise_count(prints[own] ^ np.uint64(v)).astype(int)
        todo += [(2 * i, own[away < t]), (2 * i + 1, own[away >= t - radius])]
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, int), np.zeros(0, int))


class Forest:
    """Union-find with the smallest member as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if (y == x).all():
                return x
            self.up[x] = self.up[y]
            x = y


def link_within(prints: np.ndarray, own: np.ndarray, radius: int, forest: Forest, rng: np.random.Generator) -> None:
    """Link all pairs of prints[own] at `radius` or fewer bits."""
    while len(own) > LEAF:
        part = prints[own]
        found = vantage(part[rng.integers(0, len(part), 2048)], rng, radius)
        if found is None:
            break
        away = np.bitwise_count(part ^ found[0]).astype(int)
        left, right = own[away < found[1]], own[away >= found[1] - radius]
        if max(len(left), len(right)) > 0.95 * len(own):
            break
        link_within(prints, left, radius, forest, rng)
        own = right
    part = prints[own]
    if len(own) <= DENSE or radius > 2:
        for at in range(0, len(own), BLOCK):
            near = np.bitwise_count(part[at : at + BLOCK, None] ^ part[None, at:]) <= radius
            a, b = np.nonzero(near)
            forest.link(own[a + at], own[b + at])
        return
    order = np.argsort(part)
    keys = part[order]
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    flips = [*one, *(one[i] | one[j] for i in range(64) for j in range(i))] if radius == 2 else list(one)
    for f in flips:
        at = np.searchsorted(keys, part ^ f)
        hit = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == part ^ f))
        forest.link(own[hit], own[order[at[hit]]])


def shard_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (fingerprint, smallest of its component) of the components with two members or more."""
    prints = np.unique(prints.astype(np.uint64))
    forest = Forest(len(prints))
    link_within(prints, np.arange(len(prints)), radius, forest, np.random.default_rng(11))
    roots = forest.roots(np.arange(len(prints)))
    linked = np.flatnonzero(roots != np.arange(len(prints)))
    return prints[linked], prints[roots[linked]]


def depth_for(count: int) -> int:
    """Levels of the tree that deals `count` fingerprints to shards."""
    levels = lambda leaf: int(np.ceil(np.log2(max(count, 1) / leaf)))
    return max(0, min(levels(LEAF), FLAT), min(levels(WIDE), DEPTH))


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """distinct: (fp), no repeats. Edges (a, b) that span the graph of pairs within the radius."""
    reachable(distinct.sparkSession)
    count = distinct.count()
    depth = depth_for(count)
    drawn = distinct.orderBy(F.xxhash64("fp"), "fp").limit(PER_LEAF << depth).toArrow()  # at most PER_LEAF << DEPTH numbers, 8 MB
    nodes = grow(drawn.column("fp").to_numpy().view(np.uint64), depth, radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            own, leaf = shards(prints, nodes, radius)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(prints[own].view(np.int64))], names=["leaf", "fp"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = shard_links(pdf["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.mapInArrow(deal, "leaf int, fp long").groupBy("leaf").applyInPandas(meet, "a long, b long")


def classes(prints: DataFrame, radius: int) -> DataFrame:
    """prints: (doc_id, fp). Adds component_id, the smallest doc_id reachable."""
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")), "fps")
    label = components(links(first.select("fp"), radius), "vp")
    named = first.join(label, first.fp == label.node, "left").select("fp", "doc", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    by_fp = named.join(best, "root").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(by_fp, prints.fp == by_fp._fp).drop("_fp")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, seed: int = 42, **names) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints = stored(fingerprints(docs, width, seed, **names), "prints")
    return classes(prints, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- one document of each group, by similarity ------------------------------------------------

GROUPS, DRAWN, SLACK = 14, 3, 0.4
MINIMA = GROUPS * DRAWN


def odd_numbers(n: int) -> np.ndarray:
    """n fixed odd multipliers: each permutes the 64-bit numbers."""
    return np.random.default_rng(20240611).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A further hash of each hash."""
    z = h ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int, seed: int) -> list[np.ndarray]:
    """The distinct shingles of each text as hashes, in order: a shingle's hash is mixed from the XXH64 of its words in turn. A text with fewer words has one shingle, the whole sequence."""
    import xxhash

    hashed, known, out = xxhash.xxh64_intdigest, {}, []
    for text in texts:
        words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII blanks only
        for w in set(words).difference(known):
            known[w] = hashed(w, seed)
        each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(len(each) - width + 1, 1) if len(each) else 0
        h = np.full(n, min(width, len(each)), np.uint64)
        for k in range(min(width, len(each))):
            h = mixed(h ^ each[k : k + n], k + 1)
        out.append(np.unique(h))
    return out


def sketches(texts: list[str | None], width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct shingles of each text: how many, the fingerprint, the least of them under MINIMA permutations, and the fingerprints of GROUPS samples of DRAWN such shingles. Texts without words have zeros."""
    sets = shingle_sets(texts, width, seed)
    n = np.array([len(h) for h in sets], np.int64)
    fp = np.array([majority(h) for h in sets], np.uint64)
    least, keys = np.zeros((len(n), MINIMA), np.uint64), np.zeros((len(n), GROUPS), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        flat, starts = np.concatenate(sets), (np.cumsum(n) - n)[some]
        for k, odd in enumerate(odd_numbers(MINIMA)):
            least[some, k] = np.minimum.reduceat(flat * odd, starts)
        for g in range(GROUPS):
            x, y, z = (least[:, g * DRAWN + k] * np.uint64(pow(int(odd_numbers(MINIMA)[g * DRAWN + k]), -1, 1 << 64)) for k in range(DRAWN))
            keys[:, g] = mixed((x & y) | (y & z) | (x & z), 1000 + g)  # the majority of three
    return n, fp, least, keys


def close_pairs(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that may reach `least`, with close, the share of equal minima, which estimates their similarity: the smaller set is large enough, and the estimate is not below `least` by SLACK, over six standard errors."""
    seen = bodies.select("body", "n", "minima")
    met = pairs.join(seen.toDF("a", "n_a", "m_a"), "a").join(seen.toDF("b", "n_b", "m_b"), "b")
    met = met.where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m_a, m_b = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, MINIMA) for c in ("m_a", "m_b"))
            close = (m_a == m_b).mean(axis=1)
            kept = pa.array(close >= least - SLACK)
            yield pa.RecordBatch.from_arrays([*[b.column(c).filter(kept) for c in ("a", "b")], pa.array(close).filter(kept)], names=["a", "b", "close"])

    return met.mapInArrow(estimate, "a long, b long, close double")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, least: float, seed: int) -> DataFrame:
    """The pairs (a, b) whose distinct shingles have a Jaccard similarity of `least` or more, exactly."""
    met = pairs.select("a", "b").join(texts.toDF("a", "t_a"), "a").join(texts.toDF("b", "t_b"), "b")

    def judge(batch: pa.RecordBatch) -> dict:
        bodies = dict(zip(batch.column("a").to_pylist(), batch.column("t_a").to_pylist(), strict=True)) | dict(zip(batch.column("b").to_pylist(), batch.column("t_b").to_pylist(), strict=True))
        own = dict(zip(bodies, shingle_sets(list(bodies.values()), width, seed), strict=True))
        close = []
        for a, b in zip(*[batch.column(c).to_pylist() for c in ("a", "b")], strict=True):
            shared = len(np.intersect1d(own[a], own[b], assume_unique=True))
            close.append(shared >= least * (len(own[a]) + len(own[b]) - shared) - 1e-9)
        close = pa.array(close, pa.bool_())
        return {c: batch.column(c).filter(close) for c in ("a", "b")}

    return map_batches(met, judge, "a long, b long", "t_a", 1 << 22)


def apart(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs (a, b, ..) of different components, with r_a and r_b."""
    out = pairs.join(root.toDF("a", "r_a"), "a", "left").join(root.toDF("b", "r_b"), "b", "left")
    return out.withColumn("r_a", F.coalesce("r_a", "a")).withColumn("r_b", F.coalesce("r_b", "b")).where("r_a <> r_b")


def prefix_pairs(members: DataFrame, texts: DataFrame, width: int, least: float, seed: int, stored=stored) -> DataFrame:
    """members: (body, n, root), a row per body. The pairs (a, b) of bodies of different roots that can reach `least`.

    Put the shingles that no two roots share first, the others behind them, rarest first. Such a pair then shares one of the
    n - ceil(least * n) + 1 first shingles of each side, and behind the first that it shares both sides have enough shingles
    left. A passage of many bodies stands last in that order. Every body is exploded once, whatever the size of its buckets.
    """
    met = members.join(texts, "body")

    def explode(batch: pa.RecordBatch) -> dict:
        found = shingle_sets(batch.column("text").to_pylist(), width, seed)
        at = pa.array(np.repeat(np.arange(len(found)), [len(h) for h in found]))
        return {c: batch.column(c).take(at) for c in ("body", "n", "root")} | {"shingle": pa.array(np.concatenate(found).view(np.int64))}

    cells = stored(map_batches(met.select("body", "n", "root", "text"), explode, "body long, n long, root long, shingle long", "text"), "cells")
    spread = cells.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle", "df")
    own = Window.partitionBy("body")
    shared = cells.join(spread, "shingle").withColumn("rank", F.row_number().over(own.orderBy("df", "shingle")) + F.col("n") - F.count("*").over(own))
    head = shared.where(F.col("rank") <= F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1)
    head = stored(head.select("shingle", "body", "n", "root", "rank"), "heads")
    x, y = head.alias("x"), head.alias("y")
    n_a, n_b = F.col("x.n"), F.col("y.n")
    enough = 1 + F.least(n_a - F.col("x.rank"), n_b - F.col("y.rank")) >= least / (1 + least) * (n_a + n_b) - 1e-9
    same = F.expr("x.shingle = y.shingle and x.body > y.body and x.root <> y.root")
    return x.join(y, same & enough).select(F.col("x.body").alias("a"), F.col("y.body").alias("b")).distinct()


def fingerprint_buckets(prints: DataFrame, radius: int) -> DataFrame:
    """prints: (body, n, fp). Rows (body, n, key): two bodies whose fingerprints are within the radius share a key.

    Such a pair meets in a shard, whose spanning links lead from both to one root: the key of a bucket is the root.
    """
    found = stored(links(prints.select("fp").distinct(), radius).distinct(), "vplinks")
    own = prints.select("body", "n", F.col("fp").alias("key"))
    return own.unionByName(prints.join(found, prints.fp == found.a).select("body", "n", F.col("b").alias("key"))).distinct()


def groups(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(body, doc_id, root): one row per row of docs; rows of one root are linked by similarity `least` or more of their shingles.

    Equal texts are one body from the start, and so are all texts without words. Bodies are candidates if their fingerprints are within the radius
    (found by vantage-point trees, which give buckets too) or if one of their GROUPS sample fingerprints is equal (one bucket): a pair at similarity
    0.8 shares one with probability 0.9999. Buckets are first joined by their two ends; in those that still hold more than
    one component, all pairs of different components that an exact prefix filter leaves are decided. Candidates that sizes and minima do not rule out are confirmed on their distinct
    shingles, exactly.
    """
    wordless = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(BLANKS)) == ""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.when(wordless, F.lit(0)).otherwise(F.xxhash64(text_col)).alias("body"), F.col(text_col).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        n, fp, least_of, keys = sketches(batch.column("text").to_pylist(), width, seed)
        minima = (least_of >> np.uint64(32)).astype(np.uint32)
        return {
            "doc_id": batch.column("doc_id"), "body": batch.column("body"), "n": pa.array(n), "fp": pa.array(fp.view(np.int64)), "minima": pa.array([x.tobytes() for x in minima], pa.binary()),
            "keys": pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
        }

    rows = stored(map_batches(keyed, work, f"doc_id {dict(keyed.dtypes)['doc_id']}, body long, n long, fp long, minima binary, keys array<long>", "text"), "sketches")
    spent = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        spent.append(stored(df, name))
        return spent[-1]

    bodies = kept(rows.groupBy("body").agg(*[F.first(c).alias(c) for c in ("n", "fp", "minima", "keys")]).where("n > 0"), "bodies")
    prints = bodies.select("body", "n", "fp")
    drawn = bodies.select("body", "n", F.explode(F.array_distinct("keys")).alias("key"))
    drawn = drawn.unionByName(fingerprint_buckets(prints, radius).withColumn("key", F.xxhash64("key", F.lit("fp"))))
    ends = drawn.groupBy("key").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo < hi")
    buckets = kept(drawn.join(ends, "key"), "buckets")
    pairs = buckets.select("body", F.explode(F.array("lo", "hi")).alias("other"))
    pairs = pairs.where("body <> other").select(F.greatest("body", "other").alias("a"), F.least("body", "other").alias("b")).distinct()
    texts = keyed.join(buckets.select("body").distinct(), "body", "left_semi").groupBy("body").agg(F.first("text").alias("text"))
    texts = kept(texts, "texts")
    pairs = kept(close_pairs(pairs, bodies, least), "close")
    exact = (texts, width, least, seed)
    # The closest partner of each body first, then its closest in each other component.
    good = kept(confirmed(pairs.groupBy("a").agg(F.max_by("b", F.struct("close", "b")).alias("b")), *exact), "good")
    root = components(good, "closest")
    more = apart(pairs, root).groupBy("a", "r_b").agg(F.max_by("b", F.struct("close", "b")).alias("b"))
    good = good.unionByName(kept(confirmed(more, *exact), "good"))
    root = components(good, "ends")
    held = buckets.join(root, buckets.body == root.node, "left").select("key", "body", "n", F.coalesce("root", "body").alias("root"))
    mixed_keys = held.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    held = kept(held.join(mixed_keys, "key").select("body", "n", "root").distinct(), "held")
    pairs = prefix_pairs(held, texts, width, least, seed, kept)
    good = good.unionByName(confirmed(close_pairs(pairs, bodies, least), *exact))
    root = components(good, "near")
    for done in spent:  # the answer is in `rows` and `root`
        dropped(done)
    return rows.select("body", "doc_id").join(root, rows.body == root.node, "left").select("body", "doc_id", F.coalesce("root", "body").alias("root"))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with all its columns, one row of each group of near-duplicates: the one with the smallest id (null counts as smaller than any). Texts without words are one group; of rows that repeat id and text one stays."""
    members = groups(docs, id_col=id_col, text_col=text_col, **how)
    kept = members.groupBy("root").agg(F.min(F.struct("doc_id", "body")).alias("k"), F.count("*").alias("n")).select("k.doc_id", "k.body")
    kept = stored(kept.select(F.col("doc_id").alias("_id"), F.col("body").alias("_kept")), "kept")
    wordless = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(BLANKS)) == ""
    body = F.when(wordless, F.lit(0)).otherwise(F.xxhash64(text_col))
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_own"), body.alias("_body"))
    here = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_body") == F.col("_kept"))
    out = inner.join(kept, here).select("_row", "_own", "_body")
    repeated = members.groupBy("doc_id", "body").agg(F.count("*").alias("n")).where("n > 1").join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_kept"))).isEmpty()
    out = out if repeated else out.dropDuplicates(["_own", "_body"])
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
