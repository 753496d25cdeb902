"""Anchored contexts: where a long match between documents can be, found in linear time.

Every window of `length` units of a document holds length - gram + 1 grams; the least of their hashes is the
window's anchor. Equal windows have equal anchors, wherever they stand, so a window can only be repeated
where its anchor is. Consecutive windows with one anchor form a run, and the run with all units its
windows cover is a context. All of this is array arithmetic over a buffer of many documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def finish(z: np.ndarray) -> np.ndarray:
    """Mix the bits of 64-bit numbers."""
    z = z ^ (z >> np.uint64(32))
    z = z * ODD
    z ^= z >> np.uint64(29)
    z *= BASE
    return z ^ (z >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i < n; kept per worker."""
    kept = np.__dict__.setdefault("_papyrine_powers", {})
    if not kept or len(kept["up"]) < n:
        size = max(n, 1 << 21)
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        up, down = np.full(size, BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        kept["up"], kept["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return kept["up"][:n], kept["down"][:n]


def letters() -> np.ndarray:
    """A random 64-bit number for each byte."""
    return np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Sums:
    """Polynomial hashes of every slice of a sequence of numbers, from prefix sums."""

    total: np.ndarray
    down: np.ndarray

    @staticmethod
    def of(values: np.ndarray) -> Sums:
        up, down = powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=total[1:])
        return Sums(total, down)

    def slice(self, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        return finish(self.raw(lo, hi))

    def raw(self, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        """Without the last mixing: every bit depends on all lower ones, so equality and order by the high bits are as good."""
        return (self.total[hi] - self.total[lo]) * self.down[lo]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """least[i] = min(x[i : i + width]), for len(x) - width + 1 places."""
    now, span = x, 1
    while span * 2 <= width:
        now = np.minimum(now[: len(now) - span], now[span:])
        span *= 2
    rest = width - span
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


@dataclass
class Runs:
    """Runs of windows with one anchor: the document's place in the buffer, first window (from the document's start), number of windows, anchor, the first window's place in the buffer, and whether the anchor may stand in it twice."""

    doc: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    place: np.ndarray
    loops: np.ndarray


def runs(units: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> Runs:
    """units: a hash per unit of all documents, one after another; sizes: how many each document has."""
    first = np.cumsum(sizes) - sizes
    held = np.maximum(sizes - length + 1, 0)
    if not held.any():
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.astype(np.uint64), none, none.astype(bool))
    sums = Sums.of(units)
    grams = sums.raw(slice(0, len(units) - gram + 1), slice(gram, len(units) + 1))
    width = length - gram + 1
    every = sliding_least(grams, width)  # of the window at each place, those that cross documents included
    # Heads of runs: where the least changes or a document's windows begin; the rest goes by heads only.
    full = np.flatnonzero(held)
    lo = np.union1d(np.flatnonzero(every[1:] != every[:-1]) + 1, first[full])
    owner = full[np.searchsorted(first[full], lo, side="right") - 1]
    end = first[owner] + held[owner]
    count = np.minimum(np.append(lo[1:], len(units)), end) - lo
    inside = (lo < end) & (lo >= first[full[0]])
    lo, owner, count = lo[inside], owner[inside], count[inside]
    least = every[lo]
    # A gram is the least of some window if it is as small as the largest least around it; two such grams
    # in a row that are equal and near make a window that may repeat within its own run.
    edge = np.full(width - 1, ~np.uint64(0))
    around = ~sliding_least(np.concatenate([edge, ~every, edge]), width)
    places = np.flatnonzero(grams == around)
    twice = (grams[places[1:]] == grams[places[:-1]]) & (np.diff(places) <= width)
    loops = np.isin(least, grams[places[:-1][twice]]) if twice.any() else np.zeros(len(lo), bool)
    return Runs(owner, lo - first[owner], count, least, lo, loops)
