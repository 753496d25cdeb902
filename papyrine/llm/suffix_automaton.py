"""Substring dedup: suffix automata of reference shards.

Broadcasting the automata of a whole corpus would grow with it, so the documents' runs come to the shards
instead: all contexts of one anchor (repeats.py) are a reference shard, bounded in size, and its automaton
is grown in document order. After each word the length of the state's suffix link is the matching
statistic: the longest run of words that ends here and also ended earlier in the shard. Where it reaches
`length`, the window that ends here starts earlier elsewhere. Removed are the maximal spans of such windows.

Defined cases: null, empty and blank texts have no words; texts shorter than a window lose nothing; equal
windows inside one document keep the first; rows that repeat a doc_id are ordered by the hash of their text,
equal rows count as one document; an empty table gives no rows; columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from papyrine.llm.repeats import Kind, deduplicated, oracle

LENGTH, GRAM, HOT = 20, 6, 1 << 17


class Automaton:
    """Suffix automaton of a growing sequence; push returns the longest suffix that occurred before."""

    def __init__(self) -> None:
        self.go: list[dict] = [{}]
        self.link, self.size, self.last = [-1], [0], 0

    def push(self, symbol: int) -> int:
        go, link, size = self.go, self.link, self.size
        now, p = len(go), self.last
        go.append({})
        size.append(size[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in go[p]:
            go[p][symbol] = now
            p = link[p]
        if p >= 0:
            q = go[p][symbol]
            if size[q] == size[p] + 1:
                link[now] = q
            else:
                twin = len(go)
                go.append(go[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(symbol) == q:
                    go[p][symbol] = twin
                    p = link[p]
                link[q] = link[now] = twin
        self.last = now
        return size[link[now]]


def solve(contexts: list[bytes], windows: list[int], shards: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """One automaton a shard; contexts are parted by symbols that occur once."""
    out, shard, names, automaton = [], None, {}, Automaton()
    for k, (text, n) in enumerate(zip(contexts, windows, strict=True)):
        if shards[k] != shard or not k:
            shard, names, automaton = shards[k], {}, Automaton()
        else:
            automaton.push(-k)
        push = automaton.push
        match = [push(names.setdefault(w, len(names))) for w in text.split(b" ")]
        out.append(np.array(match[length - 1 :]) >= length)
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **names) -> DataFrame:
    """One row per document: doc_id, n_units, n_removed, n_spans, spans, kept (the words that stay)."""
    return deduplicated(docs, Kind(True, length, gram, HOT), lambda c, w, s: solve(c, w, s, length), **names)


def digest(docs: DataFrame, **how) -> DataFrame:
    return without_repeats(docs, **how).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"), "n_spans")


ORACLE = oracle(
    r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')", f"array_to_string(u[i:i + {LENGTH - 1}], ' ')", LENGTH, "u[i]", "string_agg(unit, ' ' ORDER BY i) FILTER (WHERE NOT gone)", "len(u)"
).format(units="n_words", empty="''")
