"""Every query of the engine with SQL equals DuckDB's rows; all others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from blockweave import oracles
from blockweave.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name not in oracles.SQL:
        return
    r = con.execute(oracles.SQL[name])
    cols, order = [x[0] for x in r.description], sorted(df.columns)
    assert sorted(cols) == order
    pick = lambda names, rs: sorted(tuple(plain(x[names.index(c)]) for c in order) for x in rs)
    assert pick(df.columns, rows) == pick(cols, r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(oracles.SQL) <= set(QUERIES) <= set(entry.queries())
