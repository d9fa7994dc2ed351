"""Every query with SQL against DuckDB on the small tables, as rows with columns in order of their names."""

import math

import duckdb
import pytest

from tidemark import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = ["events"]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return [columns[i] for i in order], sorted((tuple(tidy(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DIR)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_runs(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0
