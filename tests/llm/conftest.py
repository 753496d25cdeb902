import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, line string"


def awkward() -> list[tuple]:
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, near and exact copies, planted passages, clashing extra columns."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = prose(60), prose(150)
    rows: list[tuple] = []

    def add(text, source="s1", doc_id=None):
        rows.append((len(rows) if doc_id is None else doc_id, text, "en", source, 0 if text is None else len(text), 1, "k", "l"))

    add(None)
    add("")
    add(" \t\n\r ")
    add("one")
    add("un été déjà vu 日本語 　x")
    for k in range(12):
        words = prose(80)
        words[20:20] = passage if k % 3 == 0 else []
        add(" ".join(words[:30]) + "\n" + " ".join(words[30:]), source=("s1", "s2", "s3", None)[k % 4])
    for _ in range(6):
        add(" ".join(base), source="hot")
    for _ in range(8):
        copy = list(base)
        copy[rng.randrange(150)] = rng.choice(vocabulary)
        add(" ".join(copy), source="hot")
    add("spam " * 300)
    add(" ".join(prose(6000)))
    for k in range(8):
        add(f"Job {k} finished without any error on the shared build host today\nalpha beta gamma delta {'omega' if k % 2 else 'sigma'} epsilon zeta eta theta iota kappa\n" + " ".join(prose(25)) + f"\n#{k}% $&|<>*")
    rows.append(rows[20])
    rows.append(rows[20])
    add("another text under a taken id " * 5, doc_id=7)
    rows.append((None, "text without an id " * 8, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from papyrine.session import reachable

    return reachable(spark).createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
