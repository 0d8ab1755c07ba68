"""The text queries with SQL equal DuckDB's rows."""

import duckdb
import pytest

from blockweave.llm import queries
from tests.test_oracles import SF, TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = con.execute(queries.SQL[name])
    cols, order = [x[0] for x in r.description], sorted(df.columns)
    assert sorted(cols) == order
    pick = lambda names, rs: sorted(tuple(plain(x[names.index(c)]) for c in order) for x in rs)
    assert pick(df.columns, [tuple(x) for x in df.collect()]) == pick(cols, r.fetchall())
