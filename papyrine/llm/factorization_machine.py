"""Quality classifier: a factorisation machine.

A text's features are its hashed words (counts damped and normalised), structure statistics
and length metadata. The score is logistic in w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j, with rank `rank` vectors;
the pairs are summed up in linear time as half of (sum v_i x_i)^2 - sum (v_i x_i)^2. It is
fitted by Adam on a bounded sample of labelled rows (`sample` rows and `entries` features at most, both parameters; drawn by a hash of the id,
so alike at every size; 128 MB on the driver) and then scores every whole text in Arrow batches; the model, whose size is fixed by `buckets` and `rank`, is
what the tasks are sent.

Defined cases: null and empty texts have the features of the empty text and a score; labels with null id or null
label are left out; without any labels, or with one class only, every score is the share of label 1 (0.5 without labels);
rows that repeat a doc_id each have a row; an empty table gives no rows; the id, language, source and
labels are never features; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from papyrine.llm.common import map_batches
from papyrine.session import stored

BUCKETS, RANK, SAMPLE, ENTRIES, THRESHOLD, FOLDS = 1 << 14, 8, 16_000, 1 << 24, 0.3, 5
STATS = 24


def statistics(raw: bytes, words: list[bytes]) -> np.ndarray:
    """STATS numbers of about unit scale: lengths, character classes, repetition, lines."""
    n, m = max(len(raw), 1), max(len(words), 1)
    chars = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digit = chars[65:91].sum(), chars[97:123].sum(), chars[48:58].sum()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    k, distinct = max(len(lines), 1), len(set(words))
    sizes = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    symbols = [chars[ord(c)] for c in "|%&$#*!<>{}=@/_"]
    same = sum(map(bytes.__eq__, words[1:], words[:-1]))
    return np.array(
        [
            np.log1p(n) / 8, np.log1p(len(words)) / 6, len(words) < 10, sizes.mean() / 8, sizes.std() / 4, sizes.max() > 40,
            10 * upper / n, digit * 20 / n, lower / n, upper > lower, min(1.0, 20 * sum(symbols[:6]) / n), min(1.0, 20 * symbols[6] / n), min(1.0, 20 * sum(symbols[7:]) / n), min(1.0, 20 * symbols[0] / n),
            (chars[46] + chars[44]) * 10 / n, chars[128:].sum() * 2 / n, distinct / m, same / m, same * 10 > m, np.log1p(len(lines)) / 4,
            1 - len(set(lines)) / k, np.log1p(n / k) / 6, sum(x[-1:] in b".!?" for x in lines) / k, sum(len(x) < 30 for x in lines) / k,
        ], np.float32,
    )


def features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(indexes, values): statistics first, then hashed words with sqrt counts of unit length."""
    raw = (text or "").encode()
    words = raw.split()
    at, count = np.unique(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets, return_counts=True)
    value = np.sqrt(count.astype(np.float32))
    value /= max(float(np.sqrt((value**2).sum())), 1e-6)
    return np.concatenate([np.arange(STATS), STATS + at.astype(np.int64)]).astype(np.int32), np.concatenate([statistics(raw, words), value]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    vector: np.ndarray
    centre: np.ndarray  # of the statistics
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        """Statistics as the model sees them, in fitting and in scoring alike."""
        return np.clip((stats - self.centre) / self.scale, -5, 5)

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        x = x.copy()
        x[:STATS] = self.standard(x[:STATS])
        v = self.vector[at]
        z = self.bias + self.weight[at] @ x + 0.5 * float(((x @ v) ** 2 - (x**2) @ (v**2)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(at: list[np.ndarray], x: list[np.ndarray], y: np.ndarray, buckets: int, rank: int, rounds: int = 12, batch: int = 256, rate: float = 0.01, decay: float = 2e-4, seed: int = 3) -> Machine:
    """Adam on the logistic loss; the rows of a batch are summed up with their starts in one flat array."""
    rng, size = np.random.default_rng(seed), STATS + buckets
    share = float(y.mean()) if len(y) else 0.5
    machine = Machine(float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), np.zeros(size, np.float32), rng.normal(0, 0.01, (size, rank)).astype(np.float32), np.zeros(STATS, np.float32), np.ones(STATS, np.float32))
    if len(y) == 0 or share in (0.0, 1.0):
        machine.vector[:] = 0
        return machine
    stats = np.array([v[:STATS] for v in x])
    machine.centre, machine.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-2)
    x = [np.concatenate([machine.standard(v[:STATS]), v[STATS:]]).astype(np.float32) for v in x]
    params = [machine.weight, machine.vector]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            n = np.array([len(at[i]) for i in rows])
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            i, v = np.concatenate([at[r] for r in rows]), np.concatenate([x[r] for r in rows])
            vec = machine.vector[i]
            vx = vec * v[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            z = machine.bias + np.add.reduceat(machine.weight[i] * v, starts) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            each = np.repeat(error, n) * v
            used, back = np.unique(i, return_inverse=True)
            g_w = np.bincount(back, each, len(used))
            g_each = each[:, None] * (np.repeat(total, n, axis=0) - vx)
            g_v = np.stack([np.bincount(back, g_each[:, f], len(used)) for f in range(rank)], axis=1)
            step += 1
            machine.bias -= rate * float(error.sum()) * 10
            for p, (m1, m2), g in zip(params, moments, (g_w, g_v), strict=True):
                g = g.astype(np.float32) + decay * p[used]
                m1[used] = 0.9 * m1[used] + 0.1 * g
                m2[used] = 0.99 * m2[used] + 0.01 * g * g
                p[used] -= rate * m1[used] / (1 - 0.9 ** min(step, 200)) / (np.sqrt(m2[used] / (1 - 0.99 ** min(step, 2000))) + 1e-6)
    return machine


def fold(id_col: Column, folds: int = FOLDS) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, rank: int = RANK, sample: int = SAMPLE, entries: int = ENTRIES, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on at most `sample` labelled rows outside the held-out fold, with at most `entries` features in all; these are fitted on the driver. Rows that repeat id and text count once."""
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    drawn = marked.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "doc_id")  # at most `sample` small rows

    def work(batch: pa.RecordBatch) -> dict:
        out = [features(t, buckets) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id").cast(pa.int64()), "body": batch.column("body"), "y": batch.column("y").cast(pa.float64()), "at": pa.array([a for a, _ in out], pa.list_(pa.int32())), "x": pa.array([v for _, v in out], pa.list_(pa.float32()))}

    found = map_batches(rows.withColumn("body", F.xxhash64("text")), work, "doc_id long, body long, y double, at array<int>, x array<float>", "text")
    found = stored(found.dropDuplicates(["doc_id", "body"]), "features")
    # Of ids that several texts share, the first rows in the order by hash, until the sample or the features are used up.
    order = found.select("doc_id", "body", F.size("at").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "body").limit(sample).collect()
    used = int(np.searchsorted(np.cumsum([r["n"] for r in order]), entries, side="right")) if order else 0
    if not used:
        return fit([], [], np.zeros(0, np.float32), buckets, rank)
    if used < found.count():
        few = found.sparkSession.createDataFrame([(r["doc_id"], r["body"]) for r in order[:used]], "doc_id long, body long")
        found = found.join(F.broadcast(few), ["doc_id", "body"])
    found = found.toArrow().sort_by([("doc_id", "ascending"), ("body", "ascending")])
    at, x = (found.column(c).combine_chunks() for c in ("at", "x"))
    ends = at.offsets.to_numpy()[1:-1] - at.offsets.to_numpy()[0]
    return fit(np.split(at.flatten().to_numpy(), ends), np.split(x.flatten().to_numpy(), ends), found.column("y").to_numpy().astype(np.float32), buckets, rank)


def scored(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    size = len(machine.weight) - STATS

    def work(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "score": pa.array([machine.score(*features(t, size)) for t in batch.column("text").to_pylist()], pa.float64())}

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(F.col(id_col)) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(plain, work, "doc_id long, held_out boolean, score double", "text").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
