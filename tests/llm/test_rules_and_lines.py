"""Operators 2 and 7: the oracles in DuckDB, brute force and awkward rows."""

import re
from collections import Counter

import duckdb
import pytest

from papyrine.llm import line_frequency, template_tree
from papyrine.llm.queries import oracle_sql, queries
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    found = con.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, found.fetchall()))


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_columns(docs, rows):
    got = line_frequency.judged(docs).collect()
    assert len(got) == len(rows)
    key = lambda r: str((r[0], *r[1:6]))
    assert sorted(map(key, got)) == sorted(key((r[0], *base(r[1]))) for r in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_frequent_lines_deplete(spark):
    rows = [(i, f"boiler plate line {i % 2}\nshared words that stand in every page here today ok" + ("\n" + " ".join(f"own{i}x{k}" for k in range(20)) if i % 3 else ""), "h") for i in range(60)]
    rows += [(100 + i, "an exact copy of a clean text with ten words or more", "h") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in line_frequency.judged(docs).collect()}
    assert got[0].kept and not got[3].kept and got[1].kept  # the first keeps its lines, later ones are depleted, own words save a page
    assert all(got[100 + i].kept for i in range(40))
    kept = {r.doc_id: r.text for r in line_frequency.kept_documents(docs).collect()}
    assert set(kept) == {i for i, r in got.items() if r.kept}
    assert "shared words" in kept[0] and "shared words" not in kept[1] and kept[1].startswith("own1x0")


def test_templates(spark, docs, none, rows):
    out = {(r.doc_id, r.text) for r in template_tree.without_templates(docs).collect()}
    jobs = [r for r in rows if r[1] and r[1].startswith("Job")]
    assert (jobs[0][0], jobs[0][1]) in out  # the first keeps all
    for r in jobs[1:]:
        left = next(t for d, t in out if d == r[0])
        assert "Job" not in left and "alpha" not in left and left.split("\n")[0] == r[1].split("\n")[2]
    assert template_tree.without_templates(docs).columns == docs.columns
    assert template_tree.without_templates(docs).count() == len(rows)
    assert template_tree.summary(none).count() == 0 and line_frequency.judged(none).count() == 0
    assert line_frequency.kept_documents(docs).columns == docs.columns


def test_short_and_numbered_lines_that_recur(spark):
    rows = [(k, f"Own words {chr(97 + k) * 5} stand here\nCopyright 20{k:02} Acme Corp\nPage {k} of 10\nRead more\n{k}\n2024-01-0{k} INFO user {k} logged in\nIn the end {chr(97 + k) * 4} {chr(98 + k) * 6} won {chr(99 + k) * 3}") for k in range(6)]
    rows += [(9, "Read more\nseen once")]
    got = {r.doc_id: r.text for r in template_tree.without_templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and got[9] == "seen once"
    for k in range(1, 6):
        own = rows[k][1].split("\n")
        assert got[k] == "\n".join([own[0], own[4], own[6]])


def test_copies_do_not_raise_the_limit(spark):
    """A line in 3 of a host's 30 different texts is above 5 %, however often the others are copied."""
    texts = [f"{'the very same line of boilerplate' if k < 3 else chr(97 + k % 26) * 3}\n" + " ".join(chr(97 + k % 26) * (2 + k // 26) + chr(97 + j % 26) * (1 + j // 26) for j in range(30)) for k in range(30)]
    rows = [(i, t, "host") for i, t in enumerate(texts + texts[3:] * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_frequency.judged(frame, min_docs=2, share=0.05)
    assert sorted((r.doc_id, r.n_removed_words) for r in got.where("n_removed_words > 0").collect()) == [(1, 6), (2, 6)]
