"""Every registered query that has an oracle, against its DuckDB SQL on the sf0.001 tables."""

import duckdb
import pytest

from conftest import SF001

def _names():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


TABLES = ("conversations documents labels embeddings events lineitem pages").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF001)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in sdf.columns]
    got = sorted((tuple(_norm(x) for x in r) for r in sdf.collect()), key=repr)
    want = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert got == want
