"""Suffix-array dedup over bytes with a run-length index.

Each batch of reference shards (repeats.py) is one text of contexts in shard and document order, parted by
separators. Of its Burrows-Wheeler transform only the runs are kept, with the text position and
the length of the match to the suffix before, sampled at each run's head. Within a run both follow by
counting on: phi(p + 1) = phi(p) + 1 and match(p + 1) = match(p) - 1 until the next sampled
position, so the samples give the matching statistics of the whole text in one stream over
positions. Suffixes chained by matches of `length` bytes or more share their first `length` bytes; the
earliest of each chain keeps its window and the others are marked.

Defined cases: null is the empty text; texts shorter than a window lose nothing; equal windows inside one document
keep the first; rows that repeat a doc_id are ordered by the hash of their text, equal rows count as one document;
an empty table gives no rows; columns other than the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from papyrine.llm.repeats import Kind, deduplicated, oracle

LENGTH, GRAM, HOT = 100, 24, 1 << 20


def words_at(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Eight symbols from each place on as one number, highest first; symbols are bytes."""
    return np.lib.stride_tricks.sliding_window_view(text, 8)[place].copy().view(">u8").ravel().astype(np.uint64)


def suffix_array(text: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """text: bytes, with 8 spare ones at its end; separator: true at separators, which end a suffix and rank by place. Prefix doubling; only suffixes not yet told apart are sorted again."""
    n = len(separator)
    # Bytes of UTF-8 end at 0xF4, so one more leaves 0 for separators.
    shown = text + np.uint8(1)
    shown[:n][separator] = 0
    shown[n:] = 0
    key = words_at(shown, np.arange(n))
    # Nothing counts beyond a separator: blank it out, and let place decide among equal keys that hold one.
    at = np.flatnonzero(separator)
    after = np.minimum(at[np.searchsorted(at, np.arange(n))] - np.arange(n), 8)
    key &= np.array([0, *(((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(1, 9))], np.uint64)[after]
    order = np.argsort(key)
    ending = np.flatnonzero(after[order] < 8)  # whole groups of equal keys, for they hold a 0
    own = order[ending]
    order[ending] = own[np.lexsort((own, key[own]))]
    tied = np.zeros(n, bool)
    tied[1:] = (key[order[1:]] == key[order[:-1]]) & (after[order[1:]] == 8)
    rank = np.empty(n, np.int64)
    step = 8
    place = np.arange(n)
    while True:
        head = np.maximum.accumulate(np.where(tied, 0, place))
        rank[order] = head
        open_ = tied.copy()
        open_[:-1] |= tied[1:]
        spots = np.flatnonzero(open_)
        if not len(spots):
            return order
        suffix = order[spots]
        second = rank[suffix + step]
        again = np.argsort(head[spots] * np.int64(n) + second)
        suffix, first, second = suffix[again], head[spots], second[again]
        order[spots] = suffix
        tied[spots[1:]] = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        tied[spots[0]] = False
        step *= 2


@dataclass
class RunIndex:
    """Runs of the transform; samples in order of text position: place, phi (the suffix before it in the order, -1: none) and match (their common prefix)."""

    symbols: np.ndarray
    starts: np.ndarray
    place: np.ndarray
    phi: np.ndarray
    match: np.ndarray
    size: int

    @staticmethod
    def of(text: np.ndarray, separator: np.ndarray) -> RunIndex:
        n = len(separator)
        order = suffix_array(text, separator)
        # The symbol before each suffix; one that follows a separator (or nothing) has none and starts a run.
        before = text[order - 1].astype(np.int16)
        bare = (order == 0) | separator[order - 1]
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | bare[1:] | bare[:-1]
        starts = np.flatnonzero(head)
        place = order[starts]
        phi = np.where(starts > 0, order[starts - 1], -1)
        by_place = np.argsort(place)
        place, phi = place[by_place], phi[by_place]
        return RunIndex(before[starts], starts, place, phi, common_prefix(text, separator, place, phi), n)

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(phi, match) of every text position, streamed from the samples."""
        at = np.zeros(self.size, np.int64)
        at[self.place] = np.arange(len(self.place))
        sample = np.maximum.accumulate(at)
        over = np.arange(self.size) - self.place[sample]
        return np.where(self.phi[sample] >= 0, self.phi[sample] + over, -1), self.match[sample] - over


def common_prefix(text: np.ndarray, separator: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, up to the first separator."""
    at = np.flatnonzero(separator)
    room = np.minimum(at[np.searchsorted(at, a)] - a, np.where(b >= 0, at[np.searchsorted(at, np.maximum(b, 0))] - b, 0))
    out, todo, done = room.copy(), np.flatnonzero(room > 0), 0
    while len(todo):
        apart = words_at(text, a[todo] + done) ^ words_at(text, b[todo] + done)
        differ = apart != 0
        if differ.any():
            # Highest set bit: the first byte that differs.
            first = 7 - (np.frexp((apart[differ] >> np.uint64(11)).astype(np.float64))[1] + 10).clip(0, 63) // 8
            small = apart[differ] < np.uint64(1 << 11)
            first = np.where(small, np.where(apart[differ] >= np.uint64(256), 6, 7), first)
            hit = todo[differ]
            out[hit] = np.minimum(room[hit], done + first)
        done += 8
        todo = todo[~differ]
        todo = todo[room[todo] > done]
    return out


def marked(text: np.ndarray, separator: np.ndarray, length: int) -> np.ndarray:
    """True at positions whose next `length` bytes also start earlier in the text."""
    phi, match = RunIndex.of(text, separator).statistics()
    here = np.arange(len(separator))
    chain = match >= length
    up = np.where(chain, phi, here)
    while True:
        further = up[up]
        if (further == up).all():
            break
        up = further
    earliest = np.full(len(here), len(here))
    np.minimum.at(earliest, up, here)
    return here > earliest[up]


def solve(contexts: list[bytes], windows: list[int], shards: list[int], length: int = LENGTH) -> list[np.ndarray]:
    text = np.frombuffer(b"\0".join(contexts) + b"\0" * 16, np.uint8)
    ends = np.cumsum([len(c) + 1 for c in contexts]) - 1
    separator = np.zeros(ends[-1] + 1, bool)
    separator[ends] = True
    gone = marked(text, separator, length)
    return [gone[e - len(c) : e - len(c) + n] for c, n, e in zip(contexts, windows, ends.tolist(), strict=True)]


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **names) -> DataFrame:
    """One row per document: doc_id, n_units, n_removed, n_spans, spans, kept (the bytes that stay)."""
    return deduplicated(docs, Kind(False, length, gram, HOT), lambda c, w, s: solve(c, w, s, length), **names)


def digest(docs: DataFrame, **how) -> DataFrame:
    return without_repeats(docs, **how).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits.
ORACLE = oracle("hex(coalesce(text, ''))", f"substr(u, 2 * i - 1, {2 * LENGTH})", LENGTH, "substr(u, 2 * i - 1, 2)", "from_hex(string_agg(unit, '' ORDER BY i) FILTER (WHERE NOT gone))", "length(u) // 2").format(units="n_bytes", empty="''::BLOB")
