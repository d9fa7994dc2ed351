"""The queries with SQL against DuckDB, and all queries' columns."""

import duckdb
import pytest

from tidemark.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = sorted(x[0] for x in want.description)
    at = [[x[0] for x in want.description].index(c) for c in columns]
    got = queries.queries()[name](spark, DIR)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
