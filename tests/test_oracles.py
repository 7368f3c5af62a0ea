"""Every query key against its DuckDB oracle on the smallest driver tables."""
import os

import pytest

import __spark_entry__ as E
from weblog.plans.catalog import QUERIES
from weblog.plans.oracles import ORACLES
from tools.oracle_check import TABLES, _close, _rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_key_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


def test_entry_without_the_training_data_operators(monkeypatch):
    import importlib
    import sys
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "weblog.llm", None)
    alone = importlib.reload(E)
    assert set(alone.queries()) == set(QUERIES) and set(alone.oracle_sql()) == set(ORACLES)
    monkeypatch.undo()
    importlib.reload(E)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_key_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[key])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    a, b = _rows(df.columns, s_rows), _rows(d_cols, res.fetchall())
    assert len(a) == len(b)
    assert _close(a, b)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["client_ip", "total_requests", "total_bytes", "average_bytes",
                          "error_rate", "distinct_endpoints"]
