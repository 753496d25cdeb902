"""Exact removal of repeated windows of words or bytes, for any order of documents.

A window is `length` consecutive units of one document; it is removed if an equal window starts earlier
(smaller id, or same document and earlier start). The work goes by anchors (see anchors.py):

1. runs: each document yields its runs (anchor, context hash, start, windows), array arithmetic only;
2. anchors seen twice or more anywhere (or twice in one run) are kept, the other runs (nearly all) are dropped;
3. equal contexts (by XXH64 of their bytes, which unlike a polynomial has no known texts that collide, and only below one anchor) are summed up to their first occurrence: every later one is removed as a whole, so a text
   that thousands copy costs one comparison;
4. anchors with two or more different contexts, or that stand twice in one, are shards: their contexts, cut from the texts, meet in (anchor)
   order and an index of the shard decides each window. An anchor whose contexts hold more than `hot` windows is
   spread by the hash of each single window; equal windows still meet, and those of one context are told apart where it is cut;
5. the removed windows are gathered by document and cut from its text.

All shuffles but the two that bring texts to the runs of their document carry numbers only, and no group has
to fit in memory: a task works through its shards one after another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from papyrine.llm.anchors import letters, runs, Sums
from papyrine.llm.common import map_batches
from papyrine.session import dropped, reachable, stored

#: (contexts, windows) -> for each context the array of its removed windows; contexts come grouped by shard, each in document order.
Solver = Callable[[list[bytes], list[int], list[int]], list[np.ndarray]]
SPREAD, BATCH, SEED = 4096, 1 << 20, 20240607


@dataclass(frozen=True)
class Kind:
    """What a unit is."""

    words: bool
    length: int
    gram: int
    hot: int

    def split(self, raw: bytes | None):
        raw = raw or b""
        return raw.split() if self.words else raw

    def joined(self, units) -> bytes:
        return b" ".join(units) if self.words else bytes(units)

    def hashes(self, texts: list) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
        """A hash per unit of all texts, the number of units of each, all units one after another (words by single spaces), and where each unit starts and ends there."""
        sizes = np.array([len(t) for t in texts], np.int64)
        table = letters()
        if not self.words:
            raw = b"".join(texts)
            return table[np.frombuffer(raw, np.uint8)], sizes, raw, np.arange(len(raw)), np.arange(1, len(raw) + 1)
        raw = b" ".join(b" ".join(t) for t in texts if t) + b" "
        buffer = np.frombuffer(raw, np.uint8)
        end = np.flatnonzero(buffer == 32) if sizes.sum() else np.zeros(0, np.int64)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        return Sums.of(table[buffer]).slice(start, end) if len(end) else np.zeros(0, np.uint64), sizes, raw, start, end


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): key orders the documents. It is the id itself; only where ids repeat or are null are rows numbered by id (null last) and hash of the text, equal rows alike."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    ids = plain.select("doc_id")
    if ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        return plain.withColumn("key", F.col("doc_id"))
    rows = plain.select("doc_id", F.xxhash64("text").alias("body")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "body")
    keys = stored(rows.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])).toDF("_d long, _b long, key long"), "keys")
    hashed = plain.withColumn("_body", F.xxhash64("text"))
    return hashed.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_body") == F.col("_b"))).select("doc_id", "text", "key")


def found_runs(docs: DataFrame, kind: Kind) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        import xxhash

        units, sizes, raw, begin, end = kind.hashes([kind.split(t) for t in batch.column("text").to_pylist()])
        r = runs(units, sizes, kind.length, kind.gram)
        key, hashed = batch.column("key").to_numpy(zero_copy_only=False), xxhash.xxh64_intdigest
        last = r.place + r.windows + kind.length - 2
        context = np.fromiter((hashed(raw[a:b], SEED) for a, b in zip(begin[r.place].tolist(), end[last].tolist(), strict=True)), np.uint64, len(last))
        return {"anchor": pa.array(r.anchor.view(np.int64)), "context": pa.array(context.view(np.int64)), "key": pa.array(key[r.doc]), "start": pa.array(r.start.astype(np.int32)), "windows": pa.array(r.windows.astype(np.int32)), "loops": pa.array(r.loops)}

    return map_batches(docs.select("key", "text"), work, "anchor long, context long, key long, start int, windows int, loops boolean", "text")


def contexts(docs: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """(anchor, salt, key, start, windows, units): the contexts of the wanted runs (anchor, hot, key, start, windows); hot ones a window each, salted by its hash, and without units the windows that stand earlier in the same context."""
    by_doc = wanted.groupBy(F.col("key").alias("_k")).agg(F.collect_list(F.struct("start", "windows", "anchor", "hot")).alias("wanted"))
    rows = docs.select("key", "text").join(by_doc, F.col("key") == F.col("_k")).select("key", "text", "wanted")

    def work(batch: pa.RecordBatch) -> dict:
        out: list[tuple] = []
        for key, text, want in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            units = kind.split(text)
            for w in want:
                s, n = w["start"], w["windows"]
                part = units[s : s + n + kind.length - 1]
                if not w["hot"]:
                    out.append((w["anchor"], 0, key, s, n, kind.joined(part)))
                    continue
                h = Sums.of(kind.hashes([part])[0]).slice(slice(0, n), slice(kind.length, None)) % SPREAD
                seen: set[bytes] = set()  # windows of this context: the later of equal ones are removed without further ado
                for i in range(n):
                    window = kind.joined(part[i : i + kind.length])
                    if window not in seen:
                        seen.add(window)
                        out.append((w["anchor"], 1 + int(h[i]), key, s + i, 1, window))
                    elif out[-1][5] is None and out[-1][3] + out[-1][4] == s + i:
                        out[-1] = (*out[-1][:4], out[-1][4] + 1, None)
                    else:
                        out.append((w["anchor"], 0, key, s + i, 1, None))
        names, kinds = ("anchor", "salt", "key", "start", "windows", "units"), (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return {n: pa.array([x[i] for x in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}

    return map_batches(rows, work, "anchor long, salt int, key long, start int, windows int, units binary", "text")


def solved(found: DataFrame, kind: Kind, solve: Solver, partitions: int) -> DataFrame:
    """(key, start, windows): runs of removed windows. Shards are worked through in order, some BATCH bytes of whole shards at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        again: list[tuple] = []  # removed already

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            shard = [hash((x[0], x[1])) for x in rows]
            gone = solve([x[5] for x in rows], [x[4] for x in rows], shard) if rows else []
            key, start, count = (list(x) for x in zip(*again, strict=True)) if again else ([], [], [])
            again.clear()
            for x, flags in zip(rows, gone, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    key.append(x[2])
                    start.append(x[3] + lo)
                    count.append(hi - lo)
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start, pa.int32()), pa.array(count, pa.int32())], names=["key", "start", "windows"])

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[5] is None:
                    again.append(row[2:5])
                    continue
                if size >= BATCH and row[:2] != held[-1][:2]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held or again:
            yield flush(held)

    ordered = found.repartition(partitions, "anchor", "salt").sortWithinPartitions("anchor", "salt", "key", "start")
    return ordered.mapInArrow(run, "key long, start int, windows int")


def removed_windows(docs: DataFrame, kind: Kind, solve: Solver) -> DataFrame:
    """docs: (key, text). (key, start, windows): runs of windows that start earlier elsewhere."""
    spark = reachable(docs.sparkSession)
    rows = stored(found_runs(docs, kind), "runs")
    again = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.max("loops").alias("loops")).where("n > 1 OR loops").select("anchor")
    seen = stored(rows.join(again.hint("shuffle_hash"), "anchor"), "seen")
    dropped(rows)
    place = F.struct("key", "start")
    each = seen.groupBy("anchor", "context").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("windows").alias("windows"), F.max("loops").alias("loops"))
    each = stored(each, "contexts")
    # Equal contexts: all but the first are removed as they stand.
    copies = each.where("n > 1").select("anchor", "context", "first")
    later = seen.join(copies, ["anchor", "context"]).where(place != F.col("first")).select("key", "start", "windows")
    # Different contexts of one anchor are a shard.
    several = each.groupBy("anchor").agg(F.count("*").alias("m"), F.sum("windows").alias("held"), F.max("loops").alias("loops")).where("m > 1 OR loops").select("anchor", (F.col("held") > kind.hot).alias("hot"))
    wanted = each.join(several, "anchor").select("anchor", "hot", F.col("first.key").alias("key"), F.col("first.start").alias("start"), "windows")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = solved(contexts(docs, wanted, kind), kind, solve, partitions)
    out = stored(later.unionByName(met), "removed")
    dropped(seen)
    dropped(each)
    return out


def covered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal runs that intervals cover, in order; intervals that touch are one run."""
    order = np.argsort(start)
    lo, hi = start[order].astype(np.int64), np.maximum.accumulate((start + size)[order].astype(np.int64)) if len(start) else start.astype(np.int64)
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return np.stack([lo[new], hi[np.append(new[1:], len(lo)) - 1]], axis=1)


def cut(docs: DataFrame, gone: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, n_units, n_removed, n_spans, spans, kept): the documents without the units their removed windows cover; spans are (start, end) pairs of units in a row."""
    by_doc = gone.groupBy(F.col("key").alias("_k")).agg(F.collect_list(F.struct("start", "windows")).alias("gone"))
    rows = docs.join(by_doc, F.col("key") == F.col("_k"), "left").select("doc_id", "text", "gone")

    def work(batch: pa.RecordBatch) -> dict:
        n_units, n_removed, n_spans, spans, kept = [], [], [], [], []
        flat, ends = batch.column("gone").fill_null([]), 0
        start, windows = (flat.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        sizes = np.diff(flat.offsets.to_numpy())
        for text, n in zip(batch.column("text").to_pylist(), sizes.tolist(), strict=True):
            units = kind.split(text)
            here = covered(start[ends : ends + n], windows[ends : ends + n] + kind.length - 1)
            ends += n
            bounds = [0, *here.ravel().tolist(), len(units)]
            stay = [units[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True)]
            n_units.append(len(units))
            n_removed.append(int((here[:, 1] - here[:, 0]).sum()))
            n_spans.append(len(here))
            spans.append(bounds[1:-1])
            kept.append(b" ".join(w for part in stay for w in part) if kind.words else b"".join(stay))
        return {"doc_id": batch.column("doc_id"), "n_units": pa.array(n_units, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())}

    return map_batches(rows, work, "doc_id long, n_units long, n_removed long, n_spans long, spans array<long>, kept binary", "text")


def deduplicated(docs: DataFrame, kind: Kind, solve: Solver, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = numbered(docs, id_col, text_col)
    return cut(rows, removed_windows(rows, kind, solve), kind)


def oracle(split: str, window: str, length: int, part: str, join: str, count: str) -> str:
    """SQL for the removal: split gives the units (a list or a string) as u and n of them; window, part and join are expressions over u and place i, units, and their aggregate."""
    return f"""
WITH d AS (SELECT doc_id, u, {count} AS n FROM (SELECT doc_id, {split} AS u FROM documents)),
p AS (SELECT doc_id, u, n, unnest(range(1, n + 1)) AS i FROM d),
w AS (SELECT doc_id, i, {part} AS unit, CASE WHEN i + {length - 1} <= n THEN md5({window}) END AS w FROM p),
f AS (SELECT doc_id, i, unit, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS again FROM w),
c AS (SELECT doc_id, i, unit, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT doc_id, i, unit, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
r AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, {join} AS kept FROM e GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS {{units}}, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, {{empty}})) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
