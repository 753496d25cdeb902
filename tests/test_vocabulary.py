"""The term trie against plain reading, with the dictionary whole in every task and dealt by first words."""

import random

import pytest
from pyspark.sql import functions as F

from papyrine.operators import vocabulary as voc


def plain(words, terms, most):
    i, out = 0, []
    while i < len(words):
        hit = next((n for n in range(min(most, len(words) - i), 0, -1) if " ".join(words[i : i + n]) in terms), 0)
        if hit:
            ui, informative = terms[" ".join(words[i : i + hit])]
            if informative:
                out.append((i + 1, " ".join(words[i : i + hit]), ui))
        i += hit or 1
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", None, "zz é ß", "a b c d e f g h " * 2000]


@pytest.fixture(scope="module")
def terms():
    rng = random.Random(4)
    return {" ".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))): (f"u{k}", rng.random() < 0.7) for k in range(60)}


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_concepts(spark, texts, terms, room):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    dictionary = spark.createDataFrame([(g, *v) for g, v in terms.items()], "gram string, ui string, informative boolean")
    got = sorted(map(tuple, voc.concepts(docs, F.split("text", " "), dictionary, 6, room).collect()))
    short = {g: v for g, v in terms.items() if len(g.split()) <= 6}
    assert got == sorted((k, *h) for k, t in enumerate(texts) for h in plain((t or "").split(" "), short, 6))
    every = voc.matches(docs, F.split("text", " "), dictionary, 6, room)
    want = sum(" ".join(w[i : i + n]) in short for t in texts for w in [(t or "").split(" ")] for i in range(len(w)) for n in range(1, 7) if i + n <= len(w))
    assert every.count() == want and set(every.columns) == {"id", "at", "n", "gram", "ui", "informative"}


@pytest.mark.parametrize("room", [1 << 20, 0])
def test_equal_terms_and_empty_inputs(spark, room):
    docs = spark.createDataFrame([("x", "lung cancer")], "id string, text string")
    two = spark.createDataFrame([("lung cancer", "u1", True), ("lung cancer", "u2", True), ("lung", "u3", True), ("", "u4", True)], "gram string, ui string, informative boolean")
    assert [tuple(r) for r in voc.concepts(docs, F.split("text", " "), two, 6, room).collect()] == [("x", 1, "lung cancer", "u2")]
    assert voc.matches(docs, F.split("text", " "), two, 6, room).count() == 3
    assert voc.matches(docs, F.split("text", " "), two.limit(0), 6, room).count() == 0
    assert voc.concepts(docs.limit(0), F.split("text", " "), two, 6, room).count() == 0


def test_concept_filters(spark):
    types = spark.createDataFrame([("a", ["Virus"]), ("b", ["Virus", "Human"]), ("c", []), ("d", None)], "ui string, types array<string>")
    assert [r.ui for r in types.where(voc.informative(F.col("types"))).collect()] == ["a"]
    paths = spark.createDataFrame([("a", "C04"), ("a", "C04.588.1"), ("b", "C04.588"), ("c", "C04.5")], "ui string, path string")
    assert {r.ui for r in voc.specific(types, paths).collect()} == {"a", "d"}
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c"), ("a", "a"), ("a", "x")], "a string, b string")
    assert sorted(map(tuple, voc.on_one_branch(pairs, paths).collect())) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "a")]


def test_terms_without_their_marks(spark):
    dictionary = spark.createDataFrame([("dual anti platelet therapy", "u1"), ("dual-antiplatelet therapy", "u2"), ("!", "u3")], "gram string, ui string")
    found = spark.createDataFrame([("lung", "u9")], "term string, ui string")
    missed = spark.createDataFrame([("lung",), ("Dual Antiplatelet Therapy",), ("?",), ("nothing",)], "term string")
    assert sorted(map(tuple, voc.rejoined(found, missed, dictionary).collect())) == [("Dual Antiplatelet Therapy", "u1"), ("lung", "u9")]
