"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(rows):
    return sorted(repr(tuple(str(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = want.project(", ".join(f'"{c}"' for c in order)).fetchall()
    assert plain(got.select(*(f"`{c}`" for c in order)).collect()) == plain(rows)


def test_entry(spark):
    assert registry.entry(spark).first()["status"] == "VERIFIED"
