"""Best-fit-decreasing packing with a segment tree over bin capacities; token-id output.

A task takes its documents in order, tokenises them, cuts overlong ones losslessly, and packs every
`batch_tokens` ids on their own: pieces by falling length, each into the open bin with the least
room that holds it. The bins' rooms are counted in the leaves of a segment tree, so the search is a
descent of log2(capacity) steps. A batch's rows are written as an id matrix (one row of `capacity`
ids per sequence, padded), the cumulative segment lengths and the positions, which start again at each
segment. Nothing is shuffled and memory is bounded by a batch and the longest document.

Defined cases: null text is the empty document (the end id only); rows that repeat a doc_id are packed each
on their own; an empty table gives no rows; columns other than the id and the text are ignored. A sequence's
number is its partition and place in it, so it is unique but not dense.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from papyrine.llm.common import slices
from papyrine.llm.linear_grouping import byte_level_encoder, cut
from papyrine.session import reachable

CAPACITY, END_ID, PAD_ID, BATCH_TOKENS = 2048, 0, 0, 4 << 20
SEQUENCES = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


class RoomTree:
    """How many open bins have each room, in a segment tree; finds the least room of at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, change: int) -> None:
        i = self.size + room
        while i:
            self.count[i] += change
            i >>= 1

    def least(self, n: int) -> int | None:
        i = self.size + n
        if self.count[i]:
            return n
        while i > 1:  # up to the first right sibling that is not empty, then down to its left
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i + (not self.count[2 * i])
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes. Ties go to the earlier piece and the bin opened or changed last."""
    tree, by_room, bins = RoomTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        room = tree.least(n)
        if room is None:
            bins.append([i])
            b, room = len(bins) - 1, capacity
        else:
            b = by_room[room].pop()
            tree.add(room, -1)
            bins[b].append(i)
        if room > n:
            by_room.setdefault(room - n, []).append(b)
            tree.add(room - n, 1)
    return bins


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID, batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed sequence: sequence_id, n_tokens, doc_ids and starts of its segments, cu_seqlens, ids and positions (little-endian, capacity entries of 32 bits)."""
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number = byte_level_encoder(tokenizer), (TaskContext.get().partitionId() << 33)
        held: list[tuple[int, int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            bins = best_fit_decreasing([len(x[2]) for x in held], capacity)
            for at in range(0, len(bins), 256):
                rows = []
                for b in bins[at : at + 256]:
                    own = [held[i] for i in b]
                    ids, positions = np.full(capacity, pad_id, "<u4"), np.zeros(capacity, "<u4")
                    bounds = np.cumsum([0, *(len(x[2]) for x in own)])
                    for (_, _, x), s, e in zip(own, bounds[:-1], bounds[1:], strict=True):
                        ids[s:e], positions[s:e] = x, np.arange(e - s)
                    rows.append((number, int(bounds[-1]), [x[0] for x in own], [x[1] for x in own], bounds.tolist(), ids.tobytes(), positions.tobytes()))
                    number += 1
                names = [x.split()[0] for x in SEQUENCES.split(", ")]
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            held.clear()

        total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    held += [(doc, s, ids[s : s + n]) for s, n in cut(len(ids), capacity)]
                    total += len(ids)
                    if total >= batch_tokens:
                        yield from flush()
                        total = 0
        if held:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SEQUENCES)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Write the sequences as Parquet: id matrix rows, cumulative lengths and positions."""
    packed.write.mode("overwrite").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    """The sequences with their ids and positions as CRC-32 of the packed bytes."""
    return packed.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))
