"""The registered SQL gives the queries' rows."""

import pytest

from watchloom.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_equals_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents embeddings pages conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.sql(oracle.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted(repr([r[c] for c in order]) for r in got.collect())
    b = sorted(repr([r[want.columns.index(c)] for c in order]) for r in want.fetchall())
    assert a == b
