"""Best-fit packing by linear grouping.

Documents are tokenised in Arrow batches, cut losslessly into pieces of at most the capacity, and only
the counts by length (at most `capacity` numbers, whatever the corpus) reach the driver. There the
large lengths are put in groups of equal cardinality and rounded up to the longest of their group; a
linear programme over bin configurations of the few group sizes is solved by column generation;
its whole part is filled with the actual lengths, longest first; what is left and the small
lengths are placed by best fit. The result is a table of runs: pieces of one length with ranks from
lo to hi go, q to a sequence, into consecutive sequences at a fixed offset. Ranks of pieces are taken
from counts by (length, bucket), with buckets in proportion to the pieces of a length, so no length meets in one task, and each
piece finds its run by binary search. The plan is made for two borders between small and large lengths; the one with fewer
sequences is used.

Defined cases: null text is the empty document (one piece: the end id); documents of the same length
are interchangeable; repeated rows are documents of their own; an empty table gives no rows; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from papyrine.llm.common import map_batches
from papyrine.session import reachable, stored

CAPACITY, END_ID, BUCKETS, LONG_RUN = 2048, 0, 1 << 24, 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
ROWS = 4096  # pieces of one length that are put in order together, about


def byte_level_encoder(path: str):
    """text -> list of ids for a byte-level BPE file of the tokenizers library; the file's vocabulary and merge order, run by tiktoken (same ids, ten times the speed). Kept per worker.

    Texts that contain an added token go through tokenizers itself, which gives such a token its id. Very long runs of blanks, on
    which the pattern would exhaust the stack, are taken out first, as the pieces that the pattern makes of them.
    """
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    kept = tiktoken.__dict__.setdefault("_papyrine_encoders", {})
    if path in kept:
        return kept[path]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
    added = sorted(t["content"] for t in spec["added_tokens"])
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding, whole = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(path)
    long_run = regex.compile(r"\p{White_Space}{%d,}+" % LONG_RUN)

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return whole.encode(text, add_special_tokens=False).ids
        if len(text) < LONG_RUN or not (runs := [m.span() for m in long_run.finditer(text)]):
            return encoding.encode_ordinary(text)
        ids, at = [], 0
        for lo, hi in runs:
            hi -= hi < len(text)  # a run is one piece, but its last blank goes with what follows
            ids += encoding.encode_ordinary(text[at:lo]) + encoding._encode_single_piece(text[lo:hi])
            at = hi
        return ids + encoding.encode_ordinary(text[at:])

    kept[path] = encode
    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: one if they fit, else the first takes what is over whole capacities."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and bucket, which deals pieces evenly, those of repeated rows too."""

    def work(batch: pa.RecordBatch) -> dict:
        encode, out = byte_level_encoder(tokenizer), []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.array([*encode(text or ""), end_id], "<u4")
            for k, (s, n) in enumerate(cut(len(ids), capacity)):
                crc = zlib.crc32(ids[s : s + n].tobytes())
                out.append((doc, k, s, n, crc, (crc + len(out) * 0x9E3779B1) % BUCKETS))
        doc, piece, start, length, crc, bucket = zip(*out, strict=True)
        return {"bucket": pa.array(bucket, pa.int32()), "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, PIECES + ", bucket int", "text")


# --- planning on counts by length -------------------------------------------------------------


def best_configuration(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity with the largest value: unbounded knapsack, one round for each item a bin can hold."""
    most = int(capacity // sizes.min())
    best, picks = np.zeros(capacity + 1), []
    for _ in range(most):
        now, pick = best.copy(), np.full(capacity + 1, -1)
        for g, s in enumerate(sizes):
            got = best[: capacity + 1 - s] + value[g]
            better = got > now[s:] + 1e-12
            now[s:][better], pick[s:][better] = got[better], g
        if (pick < 0).all():
            break
        picks.append(pick)
        best = now
    config, room = np.zeros(len(sizes), int), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            config[pick[room]] += 1
            room -= sizes[pick[room]]
    return float(best[capacity]), config


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the configuration programme by column generation with a revised simplex."""
    g = len(sizes)
    base = [np.eye(g, dtype=int)[i] * int(capacity // sizes[i]) for i in range(g)]
    inverse = np.linalg.inv(np.array(base, float).T)
    x = inverse @ demand
    for k in range(rounds):
        value = inverse.sum(axis=0)
        worth, config = best_configuration(sizes, np.maximum(value, 0), capacity)
        if worth <= 1 + 1e-6:
            break
        step = inverse @ config
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        out = int(ratio.argmin())
        base[out] = config
        x = np.maximum(x - step * ratio[out], 0)
        x[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        if k % 50 == 49:
            inverse = np.linalg.inv(np.array(base, float).T)
            x = np.maximum(inverse @ demand, 0)
    return list(zip(base, x, strict=True))


class Bins:
    """Bins by the room left in them. A kind of bin is [count, slots]; a slot is (length, first rank, q, offset): bin i of the kind holds ranks first + i * q up to q more, one after another from offset on."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room = capacity, [[] for _ in range(capacity + 1)]
        self.map = 0  # bit r is set if some bin has room r

    def put(self, room: int, count: int, slots: list) -> None:
        if count:
            self.by_room[room].append([count, slots])
            self.map |= 1 << room

    def tightest(self, length: int) -> int | None:
        above = self.map >> length
        return length + (above & -above).bit_length() - 1 if above else None

    def take(self, room: int) -> list:
        kind = self.by_room[room].pop()
        if not self.by_room[room]:
            self.map &= ~(1 << room)
        return kind

    def fill(self, length: int, first: int, count: int) -> None:
        """Best fit for count pieces of one length whose ranks start at first: the tightest bin takes as many as it holds, and so on."""
        while count:
            room = self.tightest(length)
            kind = [-(-count // (self.capacity // length)), []] if room is None else self.take(room)
            room = self.capacity if room is None else room
            bins, slots = kind
            q = room // length
            full = min(bins, count // q)
            used = self.capacity - room
            self.put(room - q * length, full, [*slots, (length, first, q, used)])
            first, count = first + full * q, count - full * q
            slots = shifted(slots, full)
            if full < bins and count and count < q:
                self.put(room - count * length, 1, [*slots, (length, first, count, used)])
                full, slots, count = full + 1, shifted(slots, 1), 0
            if full < bins and slots:
                self.put(room, bins - full, slots)


def shifted(slots: list, bins: int) -> list:
    return [(n, first + bins * q, q, at) for n, first, q, at in slots]


def pack_counts(counts: np.ndarray, capacity: int = CAPACITY, groups: int = 256, small: float = 0.4) -> dict[str, np.ndarray]:
    """counts[n]: pieces of length n. The runs by (length, lo): lo, hi, q, sequence (of rank lo), offset."""
    bins = Bins(capacity)
    left = {n: (0, int(c)) for n, c in enumerate(counts) if n and c}  # length -> ranks not placed yet
    large = [n for n in sorted(left, reverse=True) if n > small * capacity]
    total = sum(left[n][1] for n in large)
    if total:
        # Linear grouping: cut the large pieces, longest first, into groups of equal cardinality.
        edges = np.unique(np.round(np.linspace(0, total, min(groups, total) + 1)).astype(np.int64))
        ends = np.cumsum([left[n][1] for n in large])
        sizes = np.array([large[int(np.searchsorted(ends, e, side="right"))] for e in edges[:-1]])
        need = np.diff(edges)
        same = np.concatenate([[True], sizes[1:] != sizes[:-1]])
        lows = edges[:-1][same]
        sizes, need = sizes[same], np.add.reduceat(need, np.flatnonzero(same))
        highs = lows + need
        upto = lows.copy()  # next piece of each group, by its place among the large pieces

        def runs(group: int, most: int) -> list[tuple[int, int, int]]:
            """Take up to most pieces of a group: (length, first rank, count)."""
            out = []
            while most and upto[group] < highs[group]:
                i = int(np.searchsorted(ends, upto[group], side="right"))
                n = min(most, int(min(ends[i], highs[group]) - upto[group]))
                rank = int(upto[group] - (ends[i] - counts[large[i]]))
                out.append((large[i], rank, n))
                upto[group] += n
                most -= n
            return out

        for config, x in configurations(sizes, need.astype(float), capacity):
            whole = int(x + 1e-9)
            if not whole:
                continue
            slots = [runs(g, whole) for g in np.flatnonzero(config) for _ in range(config[g])]
            breaks = sorted({0, whole, *(int(b) for s in slots for b in np.cumsum([r[2] for r in s]))})
            for lo, hi in zip(breaks[:-1], breaks[1:], strict=True):
                held, used = [], 0
                for s in slots:
                    at = 0
                    for n, rank, c in s:
                        if at <= lo < at + c:
                            held.append((n, rank + lo - at, 1, used))
                            used += n
                        at += c
                if held:
                    bins.put(capacity - used, hi - lo, held)
        rest = {}
        for group in range(len(sizes)):
            for n, rank, c in runs(group, int(highs[group] - upto[group])):
                rest.setdefault(n, []).append((rank, c))
    else:
        rest = {}
    for n in sorted(left, reverse=True):
        for first, count in rest.get(n, []) if n > small * capacity else [left[n]]:
            bins.fill(n, first, count)
    rows, sequence = [], 0
    for kinds in bins.by_room:
        for count, slots in kinds:
            rows += [(n, first, first + count * q, q, sequence, at) for n, first, q, at in slots]
            sequence += count
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "lo", "hi", "q", "sequence", "offset"))} | {"sequences": np.array(sequence)}


def best_plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = 256, borders: tuple[float, ...] = (0.5, 0.4)) -> dict[str, np.ndarray]:
    """The plan with the fewest sequences, over some borders between small and large lengths; the first that needs no more than the ids fill ends the search."""
    least = -(-int((counts * np.arange(len(counts))).sum()) // capacity)
    best = None
    for small in borders:
        plan = pack_counts(counts, capacity, groups, small)
        best = plan if best is None or plan["sequences"] < best["sequences"] else best
        if best["sequences"] <= least:
            break
    return best


def ranked(found: DataFrame, counts: np.ndarray) -> DataFrame:
    """Adds rank: the place of a piece among those of its length, from 0. A length is dealt into as many buckets as ROWS pieces each need."""
    few = found.sparkSession.createDataFrame([(n, max(1, int(c) // ROWS)) for n, c in enumerate(counts) if c], "length long, _buckets int")
    dealt = found.join(F.broadcast(few), "length").withColumn("_bucket", F.col("bucket") % F.col("_buckets"))  # one row a length, at most the capacity
    cells = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    base = cells.withColumn("_base", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return dealt.withColumn("_own", own).join(base, ["length", "_bucket"]).withColumn("rank", F.col("_base") + F.col("_own"))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, groups: int = 256, **names) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    reachable(docs.sparkSession)
    found = stored(pieces(docs, tokenizer, capacity, end_id, **names), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in found.groupBy("length").count().collect():  # at most `capacity` rows
        counts[n] = c
    runs = best_plan(counts, capacity, groups)
    wide = runs["length"] * (1 << 45) + runs["lo"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            i = np.searchsorted(wide, length * (1 << 45) + rank, side="right") - 1
            over = rank - runs["lo"][i]
            seq, at = runs["sequence"][i] + over // runs["q"][i], runs["offset"][i] + over % runs["q"][i] * length
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(seq), pa.array(at)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(found, counts).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
