"""SentencePiece encoding and decoding: exact merges by backtracking.

A merge model joins, again and again, the adjacent pair whose union is the best-scored piece, the leftmost of
equals. The same pieces come out of a search from the left: the longest piece at a position (Aho-Corasick finds all
of them in one pass) is taken if it is compatible with the piece before it; if no piece there is, the position is
marked in a bitfield, the piece before it is taken back and its next shorter prefix is tried. A position once marked
is never tried again, so the search is linear in the text. Two pieces are compatible if merging the characters of
both anew never joins across the border: their last merges are undone one by one, latest first, and after each the
two parts at the border must not form a piece that would have been merged before what was just undone. Of two merges
with an equal score the left one comes first.

Normalisation and decoding are those of the library, for they are data of the model. No piece joins a character to
one that no piece holds, nor, where the vocabulary has none such, a blank behind another character; so texts are cut
there into chunks, and short chunks are encoded once a batch of work. The cache of chunks has two
generations of CHUNKS entries, that of pairs is emptied when it holds PAIRS. Pieces that merging their own characters does not give are never
used. All tables are as large as the vocabulary; the model reaches the executors as a broadcast of its bytes, so its
file need only be on the driver.

Defined cases: a null text is an empty one and has no ids; texts of any length are encoded whole; rows that repeat
an id or a text each have their row; an empty table gives no rows; columns other than id and text are ignored by
`digest` and may have any names; a model whose own pieces come out otherwise than in the library (no merge model, or
one with user-defined symbols or without byte fallback) is refused with a ValueError.
"""

from __future__ import annotations

import gc
import hashlib
import re
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from papyrine.llm.common import map_batches
from papyrine.session import reachable

CHUNK, CHUNKS, PAIRS = 48, 1 << 17, 1 << 18
BLANK = "▁"


@dataclass
class Pieces:
    """The vocabulary: by id the text, the rank (0 is merged first, -1 a character) and the two halves of the last merge."""

    texts: dict[int, str]
    rank: dict[int, int]
    halves: dict[int, tuple[int, int]]
    bytes: list[int]
    size: int
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.ids = {t: i for i, t in self.texts.items()}


def remerged(characters: list[int], pieces: Pieces) -> tuple[list[int], tuple[int, int] | None]:
    """Merge ids the plain way: best rank first, then leftmost. Also the pair that was joined last."""
    now, last = list(characters), None
    while True:
        best = None
        for k in range(len(now) - 1):
            joined = pieces.ids.get(pieces.texts[now[k]] + pieces.texts[now[k + 1]])
            if joined is not None and (best is None or pieces.rank[joined] < best[0]):
                best = (pieces.rank[joined], k, joined)
        if best is None:
            return now, last
        k = best[1]
        last = (now[k], now[k + 1])
        now[k : k + 2] = [best[2]]


@lru_cache(maxsize=2)
def load(model: bytes) -> Pieces:
    """Read a model; characters that pieces hold but that are no pieces get ids past the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = sp.get_piece_size()
    plain = [i for i in range(size) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    octets = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(map(sp.is_byte, octets)):
        raise ValueError("the model has no byte fallback")
    texts = {i: sp.id_to_piece(i) for i in plain}
    for c in sorted({c for t in texts.values() for c in t} - set(texts.values())):
        texts[size + ord(c)] = c  # given out as its bytes
    scores = sorted({sp.get_score(i) for i in plain if len(texts[i]) > 1}, reverse=True)
    place = {s: k for k, s in enumerate(scores)}
    pieces = Pieces(texts, {i: place[sp.get_score(i)] if len(t) > 1 else -1 for i, t in texts.items()}, {}, octets, size)
    for i, t in texts.items():
        if len(t) > 1:
            out, last = remerged([pieces.ids[c] for c in t], pieces)
            if out == [i]:
                pieces.halves[i] = last
    encoder = Encoder(pieces)
    probes = [texts[i] for i in plain]
    for text, ids in zip(probes, sp.encode(probes, num_threads=1), strict=True):
        if encoder.encode(sp.normalize(text)) != ids:
            raise ValueError(f"the model does not merge as expected: {text!r}")
    return pieces


class Encoder:
    """Ids of normalised texts."""

    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.pieces, self.pairs = pieces, {}
        self.chunks, self.before = {}, {}
        self.usable = usable = {t: i for t, i in pieces.ids.items() if len(t) == 1 or i in pieces.halves}
        self.size = {i: len(t) for t, i in usable.items()}
        self.shorter = {i: next((usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in usable), None) for t, i in usable.items()}
        matcher = ahocorasick.Automaton()
        joined = [t for t in usable if len(t) > 1]
        for t in joined:
            matcher.add_word(t, (usable[t], len(t) - 1))
        matcher.make_automaton()
        self.matches = matcher.iter("")
        inner = "".join(re.escape(c) for c in sorted({c for t in joined for c in t} - {BLANK}))
        behind = any(BLANK in t.lstrip(BLANK) for t in joined)
        self.cut = re.compile(f"[{inner}{BLANK}]+|." if behind else f"{BLANK}*[{inner}]+|{BLANK}+|.", re.DOTALL)
        self.bare = {i: [pieces.bytes[b] for b in t.encode()] for t, i in usable.items() if i >= pieces.size}

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b anew leaves a and b."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._stays(a, b)
        return known

    def _stays(self, a: int, b: int) -> bool:
        p = self.pieces
        before = len(p.rank)  # a union across the border counts if it ranks before this
        while True:
            union = p.ids.get(p.texts[a] + p.texts[b])
            if union is not None and p.rank[union] < before:
                return False
            if p.rank[a] < 0 and p.rank[b] < 0:
                return True
            if p.rank[a] > p.rank[b]:
                before, a = p.rank[a], p.halves[a][1]
            else:
                before, b = p.rank[b] + 1, p.halves[b][0]

    def search(self, chunk: str) -> list[int]:
        """The pieces of a chunk of known characters, by backtracking."""
        n, size, pairs = len(chunk), self.size, self.pairs
        longest = [self.usable[c] for c in chunk]
        self.matches.set(chunk, True)
        for end, (i, before) in self.matches:
            longest[end - before] = i  # ends come in order: the longest of a start comes last
        piece = longest[0]
        out, at, failed, last = [], 0, bytearray(n + 1), -1
        while True:
            end = at + size[piece]
            if not failed[end] and (last < 0 or pairs.get(last << 32 | piece) or self.fits(last, piece)):
                out.append(piece)
                if end == n:
                    return out
                at, last, piece = end, piece, longest[end]
                continue
            piece = self.shorter[piece]
            while piece is None:
                failed[at] = 1
                piece = out.pop()
                at -= size[piece]
                last = out[-1] if out else -1
                piece = self.shorter[piece]

    def chunk_ids(self, chunk: str) -> list[int]:
        whole = self.usable.get(chunk)
        if whole is not None and not self.bare:
            return [whole]  # merging its characters gives the piece
        if len(chunk) == 1 and whole is None:
            return [self.pieces.bytes[b] for b in chunk.encode()]
        out = self.search(chunk)
        return [x for i in out for x in self.bare.get(i, (i,))] if self.bare else out

    def chunk(self, chunk: str) -> tuple[tuple[int, ...], str]:
        """The ids of a chunk, and in decimal, joined by commas."""
        found = self.before.get(chunk)
        if found is None:
            ids = tuple(self.chunk_ids(chunk))
            found = ids, ",".join(map(str, ids))
        if len(chunk) <= CHUNK:
            if len(self.chunks) >= CHUNKS:  # what was used lately comes over from the generation before
                self.chunks, self.before = {}, self.chunks
            self.chunks[chunk] = found
        return found

    def written(self, normal: str) -> tuple[list[int], str]:
        """All ids of a normalised text, and in decimal, joined by commas."""
        ids, decimal, known = [], [], self.chunks
        for chunk in self.cut.findall(normal):
            found = known.get(chunk)
            if found is None:
                found = self.chunk(chunk)
                known = self.chunks
            ids += found[0]
            decimal.append(found[1])
        return ids, ",".join(decimal)

    def encode(self, normal: str) -> list[int]:
        """All ids of a normalised text."""
        return self.written(normal)[0]


@lru_cache(maxsize=2)
def tools(model: bytes):
    """The library's processor, for normal forms and decoding, and our encoder: one of each a worker process."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_proto=model), Encoder(load(model))
    gc.collect()
    gc.freeze()  # the tables stay: no later collection need walk over them
    return made


def digested(model: bytes, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
    """Of each text the number of its ids, the SHA-256 of the ids and that of what they decode to."""
    sp, encoder = tools(model)
    counts, ids_sha, text_sha = [], [], []
    for text in texts:
        ids, decimal = encoder.written(sp.normalize(text or ""))
        counts.append(len(ids))
        ids_sha.append(hashlib.sha256(decimal.encode()).hexdigest())
        text_sha.append(hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    return counts, ids_sha, text_sha


def own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def shared(docs: DataFrame, model_path: str):
    """The model's bytes as a broadcast; a model that does not merge as expected is refused here."""
    model = Path(model_path).read_bytes()
    load(model)
    return reachable(docs.sparkSession).sparkContext.broadcast(model)


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text."""
    model = shared(docs, model_path)

    def work(batch: pa.RecordBatch) -> dict:
        sp, encoder = tools(model.value)
        ids = [encoder.encode(sp.normalize(t or "")) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))}

    return map_batches(own(docs, id_col, text_col), work, "doc_id long, ids array<int>", "text")


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids decode to an empty text."""
    model = shared(rows, model_path)

    def run(batches):
        for batch in batches:
            sp, _ = tools(model.value)
            texts = [sp.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    model = shared(docs, model_path)

    def work(batch: pa.RecordBatch) -> dict:
        counts, ids_sha, text_sha = digested(model.value, batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return map_batches(own(docs, id_col, text_col), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "text")
