"""Every registered query against its SQL in DuckDB, on the smallest data set."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.10g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(name, spark, duck):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert cols
        return
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cursor.fetchall())
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["stage_order", "stage", "remaining_count"]
    counts = [r["remaining_count"] for r in df.orderBy("stage_order").collect()]
    assert counts == sorted(counts, reverse=True) and counts[0] > 0
