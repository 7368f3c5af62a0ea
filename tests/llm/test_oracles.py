"""The subpackage's queries that SQL can state, against DuckDB on the smallest tables."""
import os

import duckdb
import pytest

from tools.oracle_check import TABLES, _close, _rows
from weblog.llm.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_names():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_key_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    res = con.execute(ORACLES[key])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    assert _close(_rows(df.columns, [tuple(r) for r in df.collect()]), _rows(names, res.fetchall()))
