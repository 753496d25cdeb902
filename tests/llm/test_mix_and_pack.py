"""Operators 8, 9 and 10: water levels, exact round trips and packing bounds."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from papyrine.llm import bfd_segment_tree as bfd, linear_grouping as lg, water_filling as wf
from papyrine.llm.queries import tokenizer_path


def levels(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap, budget, full = {s: 2 * sizes[s] for s in names}, 1.5 * sum(sizes.values()), set()
    while len(full) < len(names):
        level = (budget - sum(cap[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * level > cap[s]}
        if not over:
            return {s: cap[s] if s in full else weight[s] * level for s in names}
        full |= over
    return cap


def test_mixture(docs, none, rows):
    got = wf.mixture(docs).collect()
    assert len(got) == len(rows) and wf.mixture(none).count() == 0
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").encode().split())
    want, taken = levels(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 2
    again = wf.mixture(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = wf.mixed_documents(docs).collect()
    assert wf.mixed_documents(docs).columns == docs.columns
    words = {}
    for r in mixed:
        words[r.source] = words.get(r.source, 0) + len((r.text or "").encode().split())
    assert {s: n for s, n in words.items() if n} == {s: n for s, n in taken.items() if n}


def test_repeated_ids_meet_their_target(spark):
    word = lambda n, w="w": " ".join([w] * n)
    for rows in ([(1, word(10)), (1, word(1000)), (1, word(50))], [(1, word(100))] * 7 + [(2, word(30))], [(None, word(40))] * 9 + [(None, word(41))] * 3):
        docs = spark.createDataFrame([(i, t, "a", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, `a.b` int").repartition(3)
        got = wf.mixture(docs).collect()
        total = sum(len(t.split()) for _, t in rows)
        assert abs(sum(r.taken for r in got) - 1.5 * total) <= 1 and all(r.taken <= 2 * r["size"] for r in got)
        mixed = wf.mixed_documents(docs).collect()
        assert abs(sum(len(r.text.split()) for r in mixed) - 1.5 * total) <= 1
        assert sorted(map(str, mixed)) == sorted(map(str, wf.mixed_documents(docs.repartition(2)).collect()))


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 0, "b": 5}, {None: 7, "a": 1, "é": 100, "z": 3}, {"a": 0}])
def test_targets(spark, sizes):
    got = {r.source: r.target for r in wf.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = levels(sizes) if sum(sizes.values()) else dict.fromkeys(sizes, 0)
    assert got == pytest.approx(want)


def test_packing_round_trip(docs, none, rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = sorted((str(r[0]), np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for r in rows)
    got = lg.packed(docs, tokenizer_path()).collect()
    assert lg.packed(none, tokenizer_path()).count() == 0
    at = {}
    for r in got:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(len(x) // 4 for _, x in ids)
    assert len(at) <= -(-total // 2048) + 2
    want = sorted(str((d, k, s, n, zlib.crc32(x[4 * s : 4 * (s + n)]))) for d, x in ids for k, (s, n) in enumerate(lg.cut(len(x) // 4, 2048)))
    assert sorted(str((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)) for r in got) == want


def test_plans_place_every_piece():
    rng = np.random.default_rng(2)
    for n, top in ((0, 5), (1, 2048), (40, 2048), (3000, 2048), (500, 30), (200, 1100)):
        counts = np.bincount(rng.integers(1, top + 1, n), minlength=2049)
        runs = lg.pack_counts(counts)
        room = {}
        for length in np.flatnonzero(counts):
            mine = runs["length"] == length
            assert runs["lo"][mine][0] == 0 and runs["hi"][mine][-1] == counts[length] and (runs["lo"][mine][1:] == runs["hi"][mine][:-1]).all()
            for k in np.flatnonzero(mine):
                for i in range(runs["hi"][k] - runs["lo"][k]):
                    room.setdefault(runs["sequence"][k] + i // runs["q"][k], []).append((runs["offset"][k] + i % runs["q"][k] * length, length))
        for parts in room.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts)[:-1], sorted(parts)[1:])) and sum(x for _, x in parts) <= 2048
        best = bfd.best_fit_decreasing(np.repeat(np.arange(2049), counts).tolist(), 2048)
        assert len(room) <= 1.02 * len(best) + 2


def test_segment_tree():
    rng = np.random.default_rng(4)
    tree, held = bfd.RoomTree(50), []
    for _ in range(2000):
        room = int(rng.integers(0, 51))
        if rng.random() < 0.6 or room not in held:
            held.append(room)
            tree.add(room, 1)
        else:
            held.remove(room)
            tree.add(room, -1)
        n = int(rng.integers(0, 51))
        assert tree.least(n) == min((r for r in held if r >= n), default=None)


def test_matrix(docs, none, rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = bfd.sequences(docs.coalesce(1), tokenizer_path()).collect()
    assert bfd.sequences(none, tokenizer_path()).count() == 0
    found = {}
    for r in got:
        ids, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 2048
        for doc, start, s, e in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:]):
            assert (positions[s:e] == np.arange(e - s)).all()
            found.setdefault(str(doc), []).append((start, ids[s:e].tobytes()))
    want = {}
    for r in rows:
        x = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(str(r[0]), []).extend((s, x[s : s + n].tobytes()) for s, n in lg.cut(len(x), 2048))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_added_tokens_keep_their_ids():
    path = tokenizer_path()
    encode, whole = lg.byte_level_encoder(path), Tokenizer.from_file(path)
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n<|endoftext| y", "un été <|endoftext|>'s 日本語"):
        assert 50256 in encode(text)
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_long_and_odd_texts():
    path = tokenizer_path()
    encode, whole = lg.byte_level_encoder(path), Tokenizer.from_file(path)
    blank = " " * 60_000
    odd = ["x " + blank + "y", "x" + "\n" * 60_000 + " y" + "\u3000" * 70_000 + "z", blank, "a" + " \n" * 40_000 + "b  ", "\xa0" * 55_000 + "'s", "\x1c" * 60_000 + "a", blank + "<|endoftext|>" + blank]
    rng = np.random.default_rng(12)
    bits = [" ", "  ", "\n", "<|endoftext|>", "<|endof", "text|>", "'s", "é", "日本", "12", "ab", "#!", "\x85", "\x00"]
    odd += ["".join(rng.choice(bits, rng.integers(1, 30))) for _ in range(2000)]
    for text in odd:
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids, text[:80]
    for c in (" ", "\n", "ab", " \n"):
        assert len(encode(c * (5_000_000 // len(c)) + "end")) > 10_000


def test_plan_is_as_good_as_best_fit(spark):
    counts = np.bincount(np.random.default_rng(7).integers(1, 1500, 4000), minlength=2049)
    best = bfd.best_fit_decreasing(np.repeat(np.arange(2049), counts).tolist(), 2048)
    assert lg.best_plan(counts)["sequences"] <= len(best)


def test_repeated_rows_are_dealt_evenly(spark):
    docs = spark.createDataFrame([(None, "same text")] * 9000 + [(1, None)] * 9000, "doc_id long, text string")
    got = lg.packed(docs, tokenizer_path()).toPandas()
    at = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").agg(n=("length", "sum"), k=("offset", "nunique"), m=("offset", "size"))
    assert len(got) == 18_000 and (at.n <= 2048).all() and (at.k == at.m).all()


def test_written_matrix(spark, docs, tmp_path):
    packed = bfd.sequences(docs, tokenizer_path())
    bfd.write_matrix(packed, f"file://{tmp_path}/matrix")
    back = spark.read.parquet(f"file://{tmp_path}/matrix")
    assert back.columns == packed.columns
    assert sorted(map(str, bfd.digest(back).collect())) == sorted(map(str, bfd.digest(packed).collect()))
