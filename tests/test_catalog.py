"""Every query with SQL gives the rows that DuckDB gives on the smallest tables."""

import duckdb
import pytest

from plenum.plans.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return ""
    if hasattr(v, "as_tuple"):
        v = float(v)
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert ours == theirs
