"""Every query that has check SQL against it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from faultline.llm.registry import CHECKS, QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_check(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    result = con.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(names)
    shown = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert shown(df.select(*names).collect()) == shown(result.fetchall())
