"""Every registered query of the engine against its SQL on the same tables."""

import os

import pytest

from lodestate import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_leases_fence(spark):
    """Fencing rises with each grant and never falls."""
    got = registry.QUERIES["lease_outcomes"](spark, SF).orderBy("key", "seq").collect()
    last = {}
    for r in got:
        assert r["next_token"] >= last.get(r["key"], 1)
        last[r["key"]] = r["next_token"]
    assert {r["status"] for r in got} <= {"Ok", "LeaseConflict", "StaleFencing"}
