"""Every registered citation query against its SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from bibliospark.plans import queries


def rows(columns, values):
    """Rows by column name, floats to six places."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.fixture(scope="module")
def tables():
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    with duckdb.connect() as con:
        for name in os.listdir(folder):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
        yield con


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, tables, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = tables.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
    spark.catalog.clearCache()
