"""Every query beside its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from foliant.plans import registry
from foliant.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


def compare(spark, name, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = query(spark, SF).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), name
    columns = sorted(got.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values))
    assert rows(got) == rows(want), name


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE and n != "finisher_stream"])
def test_query(spark, name):
    compare(spark, name, registry.QUERIES[name], registry.ORACLE[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
