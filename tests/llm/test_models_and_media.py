"""Operators 3 and 4: held-out accuracy, the pair identity, and search against brute force."""

import zlib

import numpy as np

from papyrine.llm import chroma, factorization_machine as fm
from papyrine.llm.queries import op3_factorization_machine


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_factorization_machine(spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    size = fm.STATS + 50
    m = fm.Machine(0.3, rng.normal(size=size), rng.normal(size=(size, 4)) / 5, np.zeros(fm.STATS), np.ones(fm.STATS))
    at, x = fm.features("a few words, and a few more words 123 !!", 50)
    z = m.bias + m.weight[at] @ x + sum(m.vector[at[i]] @ m.vector[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert abs(m.score(at, x) - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6


def test_no_labels_and_awkward_rows(spark, docs, none, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in fm.scored(docs, fm.train(docs, labels)).collect()] == [0.5] * len(rows)
    some = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    machine = fm.train(docs, some)
    assert fm.scored(docs, machine).count() == len(rows) and fm.scored(none, machine).count() == 0


def test_scoring_clips_as_fitting(spark):
    m = fm.Machine(0.0, np.ones(fm.STATS + 8), np.zeros((fm.STATS + 8, 2)), np.zeros(fm.STATS), np.full(fm.STATS, 1e-6))
    assert np.abs(m.standard(np.array([1.0] * fm.STATS))).max() == 5
    at, x = fm.features("x" * 500, 8)
    assert abs(m.score(at, x) - 1 / (1 + np.exp(-(m.standard(x[: fm.STATS]).sum() + x[fm.STATS :].sum())))) < 1e-6


def test_sample_bounds_what_repeats_bring(spark):
    rows = [(i % 4, f"text {'good' if i % 2 else 'bad'} {i}") for i in range(200)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    for how in ({"sample": 10}, {"entries": 300}, {}):
        assert len(fm.train(docs, labels, **how).weight) == fm.STATS + fm.BUCKETS


def recordings():
    rng = np.random.default_rng(1)

    def tune(n):
        return (128 + 60 * np.sin(np.cumsum(rng.choice([0.2, 0.25, 0.3, 0.4, 0.55], n).repeat(64))) + rng.normal(0, 3, n * 64)).clip(0, 255).astype(np.uint8)

    whole, other = tune(400), tune(300)
    noisy = (whole[64 * 50 : 64 * 300].astype(float) + rng.normal(0, 2, 64 * 250)).clip(0, 255).astype(np.uint8)
    rows = [(0, noisy.tobytes()), (1, whole.tobytes()), (2, other.tobytes()), (3, other.tobytes()), (100, other.tobytes()), (4, b""), (5, None), (6, b"\x80" * 5000), (200, b"abc"), (7, noisy[64 * 20 :].tobytes())]
    short = tune(16)
    rows += [(300, short[:900].tobytes()), (301, np.concatenate([short[:400], short[400:900] ^ 1]).tobytes()), (302, short[16:816].tobytes()), (303, short[:300].tobytes()), (400, short[:300].tobytes()), (304, short[:299].tobytes())]
    return rows + [(8 + k, tune(120).tobytes()) for k in range(6)] + [(None, whole[: 64 * 100].tobytes())]


def test_search(spark):
    rows = recordings()
    frame = spark.createDataFrame(rows, "id long, media binary").repartition(3)
    got = chroma.search(frame, "doc_id % 100 = 0", id_col="id").collect()
    media = {i: m or b"" for i, m in rows}
    prints = {i: [chroma.fingerprints([m], frame=s[0], hop=s[1])[0] if s else np.zeros(0, np.uint32) for s in chroma.scales(m)] for i, m in media.items()}
    first = {}
    for i in sorted((i for i in media if i is not None)):
        first.setdefault(media[i], i)
    first.setdefault(media[None], None)
    members = sorted(str((r.doc_id, r.class_id)) for r in got if r.query_class is None)
    assert members == sorted(str((i, first[m])) for i, m in media.items())
    asks = {first[media[i]] for i in media if i is not None and i % 100 == 0}
    want = set()
    for q in asks:
        for d in set(first.values()):
            if q != d and (x := chroma.best_match(prints[q], prints[d])):
                want.add((d, q, *x[:3]))
    assert {(r.doc_id, r.query_class, r.offset, r.votes, r.overlap) for r in got if r.query_class is not None} == want
    assert (1, 0, 50 * 64) in {x[:3] for x in want}
    assert {d for d, q, *_ in want if q == 300} >= {301, 302} and not any(303 in x[:2] for x in want)
    assert chroma.search(frame.limit(0), id_col="id").count() == 0


def test_excerpts_of_any_length_meet_their_recording(spark):
    """Exact excerpts of 448 to 2,000 bytes, from recordings of 3,840 bytes to a megabyte; unrelated recordings meet nothing."""
    rng = np.random.default_rng(9)
    words = rng.integers(97, 123, (4000, 7)).astype(np.uint8)
    words[:, 6] = 32

    def prose(n, seed):
        return words[np.random.default_rng(seed).integers(0, 4000, n // 7 + 1)].tobytes()[:n]

    rows, want = [], set()
    for k, size in enumerate((3840, 20_000, 1_000_000)):
        whole = prose(size, k)
        rows.append((1000 * (k + 1) + 1, whole))
        for j, length in enumerate((448, 700, 880, 900, 1500, 2000)):
            at = 16 * (20 + 7 * j)
            rows.append((1000 * (k + 1) + 100 * (j + 1), whole[at : at + length]))
            want.add((1000 * (k + 1) + 100 * (j + 1), 1000 * (k + 1) + 1, at))
    rows += [(50 + k, prose(1200, 100 + k)) for k in range(20)]
    got = chroma.search(spark.createDataFrame(rows, "doc_id long, media binary").repartition(4)).where("query_class is not null").collect()
    assert want <= {(r.query_class, r.doc_id, r.offset) for r in got}
    assert not any(r.doc_id < 100 for r in got)
