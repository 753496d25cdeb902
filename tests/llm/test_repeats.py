"""Operators 1 and 5 against brute force over all windows."""

import hashlib

import numpy as np
import pytest

from papyrine.llm import run_length_index, suffix_automaton


def order(rows):
    """Documents in the operators' order: id (null last), then rows of an id apart; equal rows are one."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if (r[0], r[1]) not in seen:
            seen.add((r[0], r[1]))
            out.append((r[0], r[1]))
    return out


def brute(rows, words, length):
    seen, out = set(), {}
    for doc, text in order(rows):
        raw = (text or "").encode()
        units = raw.split() if words else raw
        gone = np.zeros(len(units), bool)
        for s in range(len(units) - length + 1):
            w = tuple(units[s : s + length])
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = [u for u, g in zip(units, gone) if not g]
        out[doc, text] = (len(units), int(gone.sum()), hashlib.sha256(b" ".join(kept) if words else bytes(kept)).hexdigest())
    return out


@pytest.mark.parametrize("words, length, module", [(True, 20, suffix_automaton), (False, 100, run_length_index)])
def test_against_brute_force(docs, rows, words, length, module):
    # Ids that repeat with other texts are ordered by hash; keep one text per id here, and all repeats of it.
    first = {}
    for r in rows:
        first.setdefault(r[0], r[1])
    kept = [r for r in rows if first[r[0]] == r[1]]
    frame = docs.sparkSession.createDataFrame(kept, docs.schema).repartition(3)
    want = brute(kept, words, length)
    got = module.digest(frame).collect()
    assert len(got) == len(kept)
    for r in got:
        assert (r[1], r.n_removed, r.kept_sha256) == want[r.doc_id, first[r.doc_id]], r


@pytest.mark.parametrize("module", [suffix_automaton, run_length_index])
def test_repeated_ids_and_empty(docs, none, rows, module):
    assert module.digest(none).count() == 0
    got = module.digest(docs).collect()
    assert len(got) == len(rows)
    assert sum(r.n_removed for r in got) > 0
    assert {c[1] for c in ((r.doc_id, (r[1], r.n_removed, r.kept_sha256)) for r in got if r.doc_id == rows[20][0])}.__len__() == 1


@pytest.mark.parametrize("module, join, low", [(suffix_automaton, b" ", 97), (run_length_index, b"", 0)])
def test_solvers_on_small_alphabets(module, join, low):
    rng = np.random.default_rng(0)
    for _ in range(150):
        length = int(rng.integers(1, 11))
        contexts = []
        for _ in range(rng.integers(1, 10)):
            units = [bytes([low + int(x)]) for x in rng.integers(0, 3, rng.integers(length, length + 25))]
            contexts.append((units, join.join(units)))
        got = module.solve([c for _, c in contexts], [len(u) - length + 1 for u, _ in contexts], [0] * len(contexts), length)
        seen = set()
        for (units, _), flags in zip(contexts, got, strict=True):
            for s in range(len(units) - length + 1):
                w = tuple(units[s : s + length])
                assert flags[s] == (w in seen)
                seen.add(w)


def test_hot_anchor_is_spread(docs, spark):
    """Contexts of one anchor beyond the limit go by single windows, with the same result."""
    from papyrine.llm.repeats import Kind, deduplicated

    rows = sorted((r.doc_id or -1, r.n_removed, r.kept) for r in deduplicated(docs, Kind(True, 20, 6, 1), lambda c, w, s: suffix_automaton.solve(c, w, s, 20)).collect())
    assert rows == sorted((r.doc_id or -1, r.n_removed, r.kept) for r in suffix_automaton.without_repeats(docs).collect())


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


@pytest.mark.parametrize("words, length, module", [(True, 20, suffix_automaton), (False, 100, run_length_index)])
def test_texts_on_which_polynomial_hashes_agree(spark, words, length, module):
    """Sequences of Thue and Morse and their complements have equal polynomial hashes modulo 2 ** 64 for any odd base."""
    rng = np.random.default_rng(3)
    prose = lambda n: [f"p{x}" for x in rng.integers(0, 1 << 30, n)]
    letters = lambda flip: "".join("ab"[x ^ flip] for x in thue_morse(1024))
    shared, tail = prose(14), prose(15)
    rows = [(2 * k + f, " ".join(shared + [letters(f)] + tail) if k == 0 else " ".join("xy"[x ^ f] for x in thue_morse(2048)), "en", "s", 1, 1, "k", "l") for k in range(2) for f in range(2)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, key string, line string").repartition(2)
    want = brute(rows, words, length)
    for r in module.digest(frame).collect():
        assert (r[1], r.n_removed, r.kept_sha256) == want[r.doc_id, rows[r.doc_id][1]]
    if words:
        assert want[1, rows[1][1]][1] == 0


@pytest.mark.parametrize("words, length, gram, module", [(True, 20, 6, suffix_automaton), (False, 100, 24, run_length_index)])
def test_hot_periodic_texts(spark, words, length, gram, module):
    from papyrine.llm.repeats import Kind, deduplicated

    rows = [(k, " ".join(["spam", "eggs", "ham"][: 1 + k % 3] * 400), "en") for k in range(6)] + [(9, "spam " * 50 + "other words here " * 9, "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    want = brute(rows, words, length)
    for r in deduplicated(frame, Kind(words, length, gram, 1), lambda c, w, s: module.solve(c, w, s, length)).collect():
        n, gone, digest = want[r.doc_id, next(x[1] for x in rows if x[0] == r.doc_id)]
        assert (r.n_units, r.n_removed, hashlib.sha256(r.kept).hexdigest()) == (n, gone, digest)


def test_run_index_is_compressed():
    text = b"\0".join([b"the quick brown fox jumps over the lazy dog"] * 50) + b"\0" * 16
    raw = np.frombuffer(text, np.uint8)
    separator = (raw == 0)[: len(raw) - 15]
    index = run_length_index.RunIndex.of(raw, separator)
    assert len(index.starts) < len(separator) / 8
    phi, match = index.statistics()
    a = raw.tobytes()
    for p in range(0, len(separator), 7):
        if phi[p] >= 0:
            n = 0
            while not separator[p + n] and not separator[phi[p] + n] and a[p + n] == a[phi[p] + n]:
                n += 1
            assert match[p] == n
