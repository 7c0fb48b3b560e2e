"""Every query with a DuckDB twin gives the same rows as it, and every other gives rows."""

from __future__ import annotations

import duckdb
import pytest

from ledgerloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return str(round(v, 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_every_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_outcomes_add_up(spark, sf):
    counts = {r["outcome"]: r["n"] for r in QUERIES["conservation"](spark, sf).collect()}
    assert counts.pop("seen") == sum(counts.values())
