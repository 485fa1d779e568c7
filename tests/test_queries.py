"""Every registered query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

from meridex.plans import host, lexicon, registry  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return Counter(tuple(plain(r[i]) for i in order) for r in values)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    if name not in registry.ORACLE_SQL:
        assert got.count() >= 0
        return
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in got.collect()]) == rows(names, [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in want.fetchall()])
