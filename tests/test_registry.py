"""Every registered query against its check SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from faultline.plans import load
from faultline.plans.registry import CHECKS, QUERIES

SF = "/root/testdata/sf0.001"
load()


def test_every_query_has_a_check():
    assert set(CHECKS) == set(QUERIES)


def test_entry_registers_them_all():
    assert set(entry_point.queries()) >= set(QUERIES)
    assert set(entry_point.oracle_sql()) >= set(CHECKS)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _shown(value):
    return f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_check(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(map(_shown, r)) for r in df.select(*names).collect())
    result = duck.execute(CHECKS[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    wanted = sorted(tuple(_shown(r[k]) for k in at) for r in result.fetchall())
    assert got == wanted


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() > 0
