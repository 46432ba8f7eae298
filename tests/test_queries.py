"""Every registered query of the reference's kind against its DuckDB twin."""

from __future__ import annotations

import os

import duckdb
import pytest

from wordloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Queries that SQL can't express, and the test that holds each against a plain version.
PLAIN = {"near_dups": "test_near_copies_against_all_pairs", "query_words_supported": "test_support_is_that_of_all_pairs"}


def cell(x):
    return None if x is None else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(cell, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=str)
    if name not in SQL:
        assert name in PLAIN and got
        return
    answer = duck.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(cell(r[k]) for k in order) for r in answer.fetchall()), key=str)
    assert got == want
