"""Every registered query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from siltstone import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    return f"{float(value):.5f}" if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = df.collect()
    if name not in catalogue.ORACLE_SQL:  # a transform: tested by its parts elsewhere
        assert got
        return
    want = db.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert _rows(df.columns, got) == _rows(want.columns, want.fetchall())


def test_no_query_pairs_all_rows(spark):
    plan = catalogue.QUERIES["radius_pairs"](spark, DATA)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
