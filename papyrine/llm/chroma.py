"""Chroma audio fingerprints over a media column, and the search for aligned recordings.

A recording is 8-bit unsigned mono PCM in a binary column. Overlapping frames are transformed, their energy is folded
into twelve pitch classes, smoothed and normalised. Sixteen filters compare areas of the chroma image
through its integral image; each answers with two Gray-coded bits, so every frame gives one packed
32-bit integer. Recordings of equal media are one class from the start; all others are compared by their fingerprints.

Scales. SCALES gives a long and a short pair of frame and hop. Every recording has the short scale, and from 896 bytes on the long one too, so an
excerpt of 448 bytes or more (less its frames at both ends, which smoothing changes, it has three landmarks) that starts at a multiple of the short hop
meets the recording it was taken from, however long that is.

Search. The landmarks of a recording are its distinct runs of GRAM consecutive integers, each at its first place. A query
matches a recording on a scale if, at the offset most landmarks agree on (the peak of the offset histogram), at
least three and `share` of the query's landmarks agree and at most `errors` of the bits over the overlap differ. A query
that needs k of its n landmarks shares one of its n - k + 1 rarest with every match, so only those are looked up:
passages that very many recordings carry are never joined on, and no match is lost. Of all other recordings only
landmarks that some query has are kept: a bitmap of fixed size (BITS, 8 MB) of the queries' landmarks goes to every task and drops nearly all others before
anything is shuffled; the join behind it is exact, so a full bitmap costs time, never a match. Fingerprints of candidates are made again from
their media and judged whole; no other fingerprint is ever stored.

Defined cases: null and empty media are one class and match nothing; recordings of under 384 bytes have fewer than three
landmarks on any scale and match only their equals, exactly, by class; rows that repeat an id are
judged as their own class each and share the row's id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from papyrine.llm.anchors import finish
from papyrine.llm.common import map_batches
from papyrine.session import reachable, stored

RATE, FRAME, HOP, WIDTH, SHARE, ERRORS = 8000, 256, 32, 16, 0.3, 0.2
GRAM, VOTES, SCALE = 4, 3, 4096
#: (frame, hop, least bytes): the long scale and the short one.
SCALES = ((FRAME, HOP, 896), (64, 16, 0))
BITS = 1 << 26
#: Filters by a rule: the six shapes in turn, lower edge, height and width stepping through the image.
FILTERS = [(k % 6, (7 * k) % 9, 3 if k % 6 == 4 else 2 + k % 2, 4 + 4 * (k % 4)) for k in range(16)]
CUTS = (-0.25, 0.0, 0.25)


def pitch_classes(rate: int, frame: int) -> list[np.ndarray]:
    """The bins of each of the twelve classes."""
    at = np.fft.rfftfreq(frame, 1 / rate)
    heard = np.flatnonzero((at >= 28) & (at <= 3520))
    own = np.round(12 * np.log2(at[heard] / 440)).astype(int) % 12
    return [heard[own == c] for c in range(12)]


def energy(frames: np.ndarray, classes: list[np.ndarray]) -> np.ndarray:
    """(frames, 12). Sums row by row, so that a frame has the same energy in any batch."""
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    return np.stack([power[:, c].sum(axis=1) for c in classes], axis=1)


def chroma(recordings: list[bytes], rate: int = RATE, frame: int = FRAME, hop: int = HOP, at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """((frames, 12) of all recordings one after another, frames of each): smoothed over five frames of the recording, each of unit length or zero. Silence pads to one filter's width."""
    least = frame + hop * (WIDTH - 1)
    waves = [x if len(x) >= least else x + b"\x80" * (least - len(x)) for x in recordings]
    wave = np.frombuffer(b"".join(waves), np.uint8).astype(np.float32) - 128
    sizes = np.array([len(x) for x in waves])
    count = (sizes - frame) // hop + 1
    # Two frames more at each end repeat the first and the last.
    first, last = np.cumsum(sizes) - sizes, count - 1
    padded = count + 4
    step = np.arange(padded.sum()) - np.repeat(np.cumsum(padded) - padded, padded) - 2
    starts = np.repeat(first, padded) + hop * np.clip(step, 0, np.repeat(last, padded))
    views = np.lib.stride_tricks.sliding_window_view(wave, frame)
    window, classes = np.hamming(frame).astype(np.float32), pitch_classes(rate, frame)
    raw = np.concatenate([energy(views[starts[i : i + at_once]] * window, classes) for i in range(0, len(starts), at_once)])
    smooth = 0.25 * (raw[:-4] + raw[4:]) + 0.75 * (raw[1:-3] + raw[3:-1]) + raw[2:-2]
    smooth = smooth[((step >= 0) & (step <= np.repeat(last, padded)))[2:-2]]
    norm = np.sqrt((smooth**2).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-3, smooth / np.maximum(norm, 1e-3), 0), count


def areas(total: np.ndarray, y: int, height: int, x: int, width: int, n: int) -> np.ndarray:
    """Sums over rows x to x + width (of frames) and classes y to y + height, for n places."""
    return (total[x + width : x + width + n, y + height] - total[x : x + n, y + height] - total[x + width : x + width + n, y] + total[x : x + n, y]) / SCALE


def fingerprints(recordings: list[bytes | None], **how) -> list[np.ndarray]:
    """For each recording one 32-bit integer per place of the filters."""
    heard = [x for x in recordings if x]
    if not heard:
        return [np.zeros(0, np.uint32)] * len(recordings)
    image, count = chroma(heard, **how)
    total = np.zeros((len(image) + 1, 13), np.int64)  # whole numbers: sums do not depend on the batch
    total[1:, 1:] = np.round(image * SCALE).astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    n = len(image) - WIDTH + 1  # places, those across two recordings included
    code = np.zeros(n, np.uint32)
    for shape, y, h, w in FILTERS:
        whole = areas(total, y, h, 0, w, n)
        if shape == 0:  # all, against the mean of an even frame
            part, size, rest = whole, h * w, np.full(n, 12**-0.5)
        elif shape == 1:  # upper against lower classes
            part, size = areas(total, y + h - h // 2, h // 2, 0, w, n), (h // 2) * w
        elif shape == 2:  # later against earlier frames
            part, size = areas(total, y, h, w // 2, w // 2, n), h * (w // 2)
        elif shape == 3:  # diagonal quarters
            low, high = h // 2, h - h // 2
            part, size = areas(total, y, low, w // 2, w // 2, n) + areas(total, y + low, high, 0, w // 2, n), h * (w // 2)
        elif shape == 4:  # the middle class of three
            part, size = areas(total, y + 1, 1, 0, w, n), w
        else:  # the middle frames
            part, size = areas(total, y, h, w // 4, w // 2, n), h * (w // 2)
        if shape:
            rest = (whole - part) / (h * w - size)
        value = np.log(0.05 + part / size) - np.log(0.05 + rest)
        level = (value > CUTS[0]).astype(np.uint32) + (value > CUTS[1]) + (value > CUTS[2])
        code = (code << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    ends = np.cumsum(count)
    own = iter([code[e - c : e - WIDTH + 1] for e, c in zip(ends, count, strict=True)])
    return [next(own) if x else np.zeros(0, np.uint32) for x in recordings]


def landmarks(code: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(key, place): each distinct run of `gram` integers at its first place."""
    n = len(code) - gram + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(gram):
        key = finish(key * np.uint64(31) + code[k : k + n])
    return np.unique(key, return_index=True)


def aligned(query: np.ndarray, other: np.ndarray) -> tuple[int, int, int, float]:
    """(offset, votes, overlap, share of differing bits) at the peak of the offset histogram; ties go to the least shift, then the lower offset."""
    (k_q, p_q), (k_o, p_o) = landmarks(query), landmarks(other)
    _, i, j = np.intersect1d(k_q, k_o, assume_unique=True, return_indices=True)
    if not len(i):
        return 0, 0, 0, 1.0
    offsets, votes = np.unique(p_o[j] - p_q[i], return_counts=True)
    best = min(range(len(offsets)), key=lambda k: (-votes[k], abs(offsets[k]), offsets[k]))
    at = int(offsets[best])
    lo, hi = max(0, -at), min(len(query), len(other) - at)
    differ = int(np.bitwise_count(query[lo:hi] ^ other[lo + at : hi + at]).sum())
    return at, int(votes[best]), hi - lo, differ / (32 * (hi - lo))


def matches(query: np.ndarray, other: np.ndarray, share: float = SHARE, errors: float = ERRORS) -> tuple[int, int, int, float] | None:
    found = aligned(query, other)
    need = max(VOTES, int(np.ceil(share * len(landmarks(query)[0]))))
    return found if found[1] >= need and found[3] <= errors else None


def scales(media: bytes | None) -> list[tuple[int, int] | None]:
    """(frame, hop) of each scale the recording has, else None."""
    return [(frame, hop) if media and least <= len(media) else None for frame, hop, least in SCALES]


def codes_of(media: list[bytes | None], rate: int = RATE) -> list[list[np.ndarray]]:
    """Of each recording one fingerprint a scale, empty where it has not the scale."""
    own = [scales(m) for m in media]
    each = [fingerprints([m if s[k] else None for m, s in zip(media, own, strict=True)], rate=rate, frame=frame, hop=hop) for k, (frame, hop, _) in enumerate(SCALES)]
    return [list(x) for x in zip(*each, strict=True)]


def marked(codes: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    """The landmarks of each recording and scale; one of the second scale differs from one of the first."""
    return [[finish(landmarks(c)[0] + np.uint64(k)) for k, c in enumerate(own)] for own in codes]


def first_scale_codes(size: Column) -> Column:
    """How many integers a recording of so many bytes has on the first scale that it has."""
    out = F.lit(0)
    for frame, hop, least in reversed(SCALES):
        n = F.floor((F.greatest(size, F.lit(frame + hop * (WIDTH - 1))) - frame) / hop) + 2 - WIDTH
        out = F.when((size > 0) & (size >= least), n).otherwise(out)
    return out.cast("long")


def filled(keys: DataFrame) -> np.ndarray:
    """A bitmap of BITS bits with those of the keys set; what the driver gets is that bitmap, whatever the number of keys."""
    at = keys.select((F.col("key").bitwiseAND(BITS - 1) + 1).alias("b"))
    parts = at.groupBy(F.expr("bitmap_bucket_number(b)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for r in parts.toLocalIterator():
        out[r.k - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.ravel()


def best_match(query: list[np.ndarray], other: list[np.ndarray], share: float = SHARE, errors: float = ERRORS) -> tuple[int, int, int, float] | None:
    """The match on the first scale that gives one; the offset in bytes, the overlap in places of that scale."""
    for x, y, (_, hop, _) in zip(query, other, SCALES, strict=True):
        if len(x) and len(y) and (found := matches(x, y, share, errors)):
            return found[0] * hop, *found[1:]
    return None


def search(docs: DataFrame, queries_by: str = "doc_id % 100 = 0", id_col: str = "doc_id", media_col: str = "media", share: float = SHARE, errors: float = ERRORS, **how) -> DataFrame:
    """Rows (doc_id, class_id, n_codes, query_class, offset, votes, overlap, bit_error_rate).

    Every document has its class, the smallest id with its media, in one row without a query; the row of a class's
    representative is followed by one for each class that holds a query and matches it.
    """
    spark = reachable(docs.sparkSession)
    media = F.coalesce(F.col(media_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(media).alias("media_id"), media.alias("media")).withColumn("cls", F.xxhash64("media_id"))
    own = stored(rows.select("doc_id", "media_id", F.octet_length("media").alias("size")), "own")
    reps = own.groupBy("media_id").agg(F.min("doc_id").alias("class_id"), F.max(F.expr(queries_by)).alias("asks"), first_scale_codes(F.first("size")).alias("n_codes"))
    reps = stored(reps.withColumn("cls", F.xxhash64("media_id")), "classes")

    def ask(batch: pa.RecordBatch) -> dict:
        found = marked(codes_of(batch.column("media").to_pylist(), **how))
        n = np.array([[len(x) for x in f] for f in found], np.int64).reshape(-1, len(SCALES))
        cls, total = batch.column("cls").to_numpy(zero_copy_only=False), n.sum(axis=1)
        keys = np.concatenate([x for f in found for x in f]) if found else np.zeros(0, np.uint64)
        return {"cls": pa.array(np.repeat(cls, total)), "scale": pa.array(np.repeat(np.tile(np.arange(len(SCALES)), len(n)), n.ravel()).astype(np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(np.repeat(n.ravel(), n.ravel()))}

    asking = rows.join(reps.where("asks").select("media_id"), "media_id", "left_semi").dropDuplicates(["media_id"])
    asked = stored(map_batches(asking.select("cls", "media"), ask, "cls long, scale int, key long, n long", "media"), "asked")
    bits = spark.sparkContext.broadcast(filled(asked))

    def heard(batch: pa.RecordBatch) -> dict:
        found, on = marked(codes_of(batch.column("media").to_pylist(), **how)), bits.value
        keys = [np.concatenate(f) for f in found]
        at = [k & np.uint64(BITS - 1) for k in keys]
        kept = [k[(on[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)] for k, p in zip(keys, at, strict=True)]
        cls = np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), [len(k) for k in kept])
        return {"cls": pa.array(cls), "key": pa.array((np.concatenate(kept) if kept else np.zeros(0, np.uint64)).view(np.int64))}

    every = map_batches(rows.select("cls", "media"), heard, "cls long, key long", "media")
    hits = stored(every.join(asked.select("key").distinct().hint("shuffle_hash"), "key").distinct(), "hits")
    spread = hits.groupBy("key").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("cls", "scale").orderBy("df", "key"))
    rarest = asked.join(spread, "key").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.greatest(F.lit(VOTES), F.ceil(F.col("n") * share)) + 1)
    pairs = rarest.select(F.col("cls").alias("q"), "key").join(hits.select("key", F.col("cls").alias("d")), "key").where("q <> d").select("q", "d").distinct()
    pairs = stored(pairs, "pairs")
    some = pairs.select(F.explode(F.array("q", "d")).alias("cls")).distinct()

    def fingerprint(batch: pa.RecordBatch) -> dict:
        codes = codes_of(batch.column("media").to_pylist(), **how)
        return {"cls": batch.column("cls"), "codes": pa.array([[c.tobytes() for c in x] for x in codes], pa.list_(pa.binary()))}

    again = rows.select("doc_id", "cls", "media").join(some, "cls", "left_semi").join(reps.select("cls", "class_id"), "cls").where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    codes = map_batches(again.select("cls", "media"), fingerprint, "cls long, codes array<binary>", "media").dropDuplicates(["cls"])
    sides = stored(codes.join(reps.select("cls", "class_id"), "cls").select("cls", "class_id", "codes"), "sides")
    met = pairs.join(sides.toDF("q", "q_class", "q_codes"), "q").join(sides.toDF("d", "d_class", "d_codes"), "d")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, d = ([[np.frombuffer(c, np.uint32) for c in codes] for codes in b.column(x).to_pylist()] for x in ("q_codes", "d_codes"))
            found = [best_match(x, y, share, errors) for x, y in zip(q, d, strict=True)]
            rows = [(c, s, *f) for c, s, f in zip(b.column("d").to_pylist(), b.column("q_class").to_pylist(), found, strict=True) if f]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["cls", "query_class", "offset", "votes", "overlap", "bit_error_rate"])

    found = met.mapInArrow(judge, "cls long, query_class long, offset long, votes long, overlap long, bit_error_rate double")
    members = own.select("doc_id", "media_id").join(reps.select("media_id", "class_id", "n_codes"), "media_id").select("doc_id", "class_id", "n_codes")
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("query_class", "long"), ("offset", "long"), ("votes", "long"), ("overlap", "long"), ("bit_error_rate", "double"))]
    paired = found.join(reps.select("cls", "class_id", "n_codes"), "cls").select(F.col("class_id").alias("doc_id"), "class_id", "n_codes", "query_class", "offset", "votes", "overlap", "bit_error_rate")
    return members.select("*", *blank).unionByName(paired)
