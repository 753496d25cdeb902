"""Operators 11, 12 and 13: exact round trips, the audit against plain counting, ids against the library."""

import hashlib
import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from papyrine.llm import fill_in_middle as fim, filter_audit as audit, piece_merges as pm
from papyrine.llm.queries import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


# --- 11


def rearranged(doc_id, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    hexed = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(hexed[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middle(docs, none, rows):
    got = sorted(map(tuple, fim.digest(docs).collect()), key=str)
    want = []
    for r in rows:
        n, form, p, m, out = rearranged(r[0], r[1] or "")
        want.append((r[0], n, form, p, m, sha(out), sha(r[1] or "")))
    assert got == sorted(want, key=str)
    assert fim.digest(none).count() == 0 and len({r[2] for r in got}) == 3


def test_middle_of_awkward_texts(spark):
    texts = ["<P>", "a <S> b", "x<M>", "<", "<P", "<P <S <M", "a<\x0b<S\n<\tP>", " ", "\n\n", "a ", " a", "a  b\n", "é 日本 🜁x", "\xa0  \x85 x", "<" * 50, "P>S>M> " * 9, "word " * 200_000, "x" * 1_000_000, " " * 1_000_000]
    rows = [(k, t) for k, t in enumerate(texts * 8)]
    docs = spark.createDataFrame(rows, "units long, form string")  # clashing names
    got = {r.doc_id: r for r in fim.digest(docs, id_col="units", text_col="form").collect()}
    for k, t in rows:
        n, form, p, m, out = rearranged(k, t)
        assert tuple(got[k]) == (k, n, form, p, m, sha(out), sha(t))


def test_middle_shares(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    forms = {r.form: r["count"] for r in fim.transformed(docs, rate=100, spm=25).groupBy("form").count().collect()}
    assert set(forms) == {"spm", "psm"} and 800 < forms["spm"] < 1200
    back = fim.restored(fim.transformed(docs)).where("text <> 'a b c d e f'")
    assert back.count() == 0


# --- 12


def plain_audit(rows, labels):
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    failed = []
    for d, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (d is not None and d > least[t])
        failed.append((part or "", fails, d in good, d in toxic))
    out = []
    for part in {p for p, *_ in failed}:
        own = [x for x in failed if x[0] == part]
        some, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                kept = [x for x in own if not set(x[1]) & set(order[: k + 1])]
                gone = [x for x in own if f in x[1] and not set(x[1]) & set(order[:k])]
                shapley[f] += len(gone)
                late = [x for x in own if f in x[1] and set(x[1]) & set(order[:k])]
                some.append((part, "".join(order), k + 1, len(kept), len(gone), len(late), sum(x[1] == f for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in some]
    return sorted(out)


@pytest.fixture(scope="module")
def labels(spark):
    return [(k, k % 2, (k % 5 == 0) * 1) for k in range(0, 45)] + [(3, None, None), (4, 1, 0), (4, 0, 1), (None, 1, 1)]


def test_audit(spark, docs, none, rows, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, audit.audit(docs, marks).collect()))
    assert got == plain_audit([(r[0], r[1], r[3]) for r in rows], labels)
    assert audit.audit(none, marks).count() == 0
    assert audit.audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_copies_over_many_tasks(spark, labels):
    rng = random.Random(3)
    texts = ["the hot copy " * 30, "a second text", "", None, *[f"single {k}" for k in range(40)]]
    rows = [(rng.choice([None, *range(500)]), rng.choice(texts[:4]) if rng.random() < 0.8 else rng.choice(texts), rng.choice(["x", "y", None])) for _ in range(1500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        docs = spark.createDataFrame(rows, "mask long, task string, first string")  # clashing names
        marks = spark.createDataFrame(labels, "mask long, quality int, toxic int")
        got = audit.audit(docs, marks, id_col="mask", text_col="task", part_col="first")
        assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_audit_with_other_filters(spark, docs, labels):
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.audit(docs, marks, filters=lambda text, words: {"S": F.size(words) < 5})
    assert {r.filter_order for r in got.collect()} == {"SE", "ES"}


# --- 13


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces(docs, none, rows, library):
    got = sorted(map(tuple, pm.digest(docs, MODEL).collect()), key=str)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str) and pm.digest(none, MODEL).count() == 0


def test_pieces_round_trip(spark, docs, rows, library):
    back = pm.decoded(pm.encoded(docs.where("doc_id is not null"), MODEL), MODEL)
    assert sorted(map(tuple, back.collect())) == sorted((r[0], library.decode(library.encode(r[1] or ""))) for r in rows if r[0] is not None)


def test_pieces_of_random_texts(library):
    _, encoder = pm.tools(open(MODEL, "rb").read())
    rng, pool = random.Random(11), list(encoder.usable)
    for k in range(6000):
        n, kind = rng.randint(1, 12), k % 6
        if kind == 0:
            t = "".join(rng.choice(pool) for _ in range(n)).replace("▁", " ")
        elif kind == 1:
            t = "".join(rng.choice(" ▁at\n") for _ in range(5 * n))
        elif kind == 2:
            t = "".join(rng.choice("abcdeinrst ") for _ in range(4 * n))
        elif kind == 3:
            t = "".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x2000, 0x9FFF), rng.randint(0x10000, 0x1FFFF)])) for _ in range(n))
        elif kind == 4:
            t = " " * rng.randint(0, 70) + rng.choice(pool) + "\t" * rng.randint(0, 9) + " " * rng.randint(0, 40)
        else:
            t = "".join(rng.choice("=-*/.#0123") for _ in range(8 * n))
        assert encoder.encode(library.normalize(t)) == library.encode(t), t


def test_pieces_of_long_chunks(library):
    _, encoder = pm.tools(open(MODEL, "rb").read())
    for t in ("ab" * 200_000, "a" * 300_000, " " * 300_000, "thequickbrownfox" * 20_000, "日本語" * 50_000):
        assert encoder.encode(library.normalize(t)) == library.encode(t)


def test_pieces_hold_with_small_caches(library, monkeypatch):
    monkeypatch.setattr(pm, "CHUNKS", 3)
    monkeypatch.setattr(pm, "PAIRS", 5)
    encoder = pm.Encoder(pm.load(open(MODEL, "rb").read()))
    rng = random.Random(2)
    for _ in range(300):
        t = " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 9))) for _ in range(12))
        assert encoder.encode(library.normalize(t)) == library.encode(t)


def test_pieces_stay_by_merging_anew():
    pieces = pm.load(open(MODEL, "rb").read())
    encoder, rng, usable = pm.Encoder(pieces), random.Random(4), None
    usable = sorted(i for i in encoder.usable.values())
    for _ in range(4000):
        a, b = rng.choice(usable), rng.choice(usable)
        characters = [pieces.ids[c] for c in pieces.texts[a] + pieces.texts[b]]
        assert encoder.fits(a, b) == (pm.remerged(characters, pieces)[0] == [a, b])
