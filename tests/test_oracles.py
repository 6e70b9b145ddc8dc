"""Every query against its DuckDB twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidefold.plans.base import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, (str, bool)):
        return str(value)
    if hasattr(value, "isoformat"):
        return value.isoformat().removesuffix("T00:00:00").removesuffix("+00:00")
    return f"{float(value):.6f}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    out = QUERIES[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in out.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
