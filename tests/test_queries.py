"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from foliospark import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, oracle, name):
    frame = registry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in frame.collect()), key=repr)
    found = oracle.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_kernels_over_tables(spark, name):
    rows = registry.queries()[name](spark, SF).collect()
    assert rows and not any(r["error"] for r in rows if "error" in r.__fields__)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
