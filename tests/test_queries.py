"""Every query against its SQL on the smallest tables; the others for rows and a stable schema."""

import os

import duckdb
import pytest

import __spark_entry__
from papyrine.plans import catalog
from tests.conftest import DATA

catalog.load()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def rows(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(r[i]) for i in order) for r in records)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["a", "b", "cosine", "jaccard", "score", "above"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_latest_orders_by_its_window(spark):
    """The order belongs to the numbering itself: a sort below it is lost in the shuffle."""
    plan = catalog.QUERIES["latest_lateral"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderdate" in plan.split("row_number()")[1].split("\n")[0]


def test_every_delimited_row(spark, tmp_path):
    suppliers = spark.range(20_500).selectExpr("id AS s_suppkey", "concat('S;', id) AS s_name", "CAST(id % 25 AS INT) AS s_nationkey")
    suppliers.write.parquet(str(tmp_path / "supplier.parquet"))
    got = catalog.QUERIES["delimited_rows"](spark, str(tmp_path))
    assert got.distinct().count() == 20_500 and got.where("s_name <> concat('S;', s_suppkey)").count() == 0


def test_survivors_with_unknown_fields(spark, con, tmp_path):
    """Null texts are one class; unlabelled copies, and copies with a null field, count no field; a null length is last."""
    docs = [(1, "x", "en", "b", 3), (2, "x", "fr", "c", 3), (3, None, "en", None, 1), (4, None, "fr", "a", 1), (5, "y", "en", "a", None), (6, "y", "en", "a", 1), (7, "z", "fr", "a", 1), (8, "u", "de", "a", 2), (9, "u", "en", "b", 2)]
    marks = [(4, 1, None), (8, 0, 0), (9, 1, 1)]
    tables = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (marks, "doc_id long, quality int, toxic int")}
    own = duckdb.connect()
    for name, (rows_, kind) in tables.items():
        spark.createDataFrame(rows_, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    df = catalog.QUERIES["cluster_survivors"](spark, str(tmp_path))
    want = own.execute(catalog.ORACLES["cluster_survivors"])
    columns = [c[0] for c in want.description]
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), columns) and df.count() == 8
