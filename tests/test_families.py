import pytest

from tests.fixtures_data import cleaned
from weblog.operators import families
from weblog.operators.checks import diff_rows


@pytest.mark.parametrize("family", families.FAMILIES)
def test_dataframe_and_sql_agree(spark, family):
    logs = cleaned(spark)
    a = families.build(spark, logs, family, "DataFrame")
    b = families.build(spark, logs, family, "SQL")
    assert a.keys() == b.keys()
    for name in a:
        assert diff_rows(a[name], b[name]).count() == 0, (family, name)


def test_family_from_parquet_path(spark, tmp_path):
    p = str(tmp_path / "t")
    cleaned(spark).write.parquet(p)
    r = families.build(spark, p, "perhost_traffic_profiling")
    assert r["metrics_per_host"].count() == 3


def test_unknown_family(spark):
    with pytest.raises(ValueError):
        families.build(spark, cleaned(spark), "nope")


@pytest.mark.parametrize("family", families.FAMILIES)
def test_reports(spark, family):
    from jobs.report import reports
    d = spark.createDataFrame([("10.0.0.1", "alpha")], "client_ip string, hostname string")
    for title, df in reports(spark, cleaned(spark), family, n=2, directory=d):
        rows = df.collect()
        assert 0 < len(rows) <= 2, title
        if "hostname" in df.columns:
            assert {r.hostname for r in rows} <= {"alpha", "10.0.0.2", "10.0.0.4"}


@pytest.mark.parametrize("api", families.APIS)
def test_empty_log_gives_empty_results(spark, api):
    from weblog.operators import sessions as S
    logs = cleaned(spark).where("false")
    for fam in families.FAMILIES:
        for name, df in families.build(spark, logs, fam, api).items():
            assert df.count() == 0, (fam, name)
    assert S.session_rows(logs).count() == 0
    assert S.assign_session_ids(logs).count() == 0
    assert S.sessions_by_window(logs).count() == 0


@pytest.mark.parametrize("api", families.APIS)
def test_materialized_sessions_equal_lazy(spark, api):
    logs = cleaned(spark)
    lazy = families.build(spark, logs, "sessionization", api)
    mat = families.build(spark, logs, "sessionization", api, materialize=True)
    for name in lazy:
        assert diff_rows(lazy[name], mat[name]).count() == 0, name
    # the derived result reads the checkpoint, not the log table
    from tools.inspect_plan import plan_text
    assert "Scan ExistingRDD" in plan_text(mat["per_ip"], "simple") or \
        "LogicalRDD" in plan_text(mat["per_ip"], "extended")


@pytest.mark.parametrize("family", ["error_pattern_analysis", "temporal_aggregation"])
def test_materialized_families_equal_lazy(spark, family):
    from weblog import fixtures as fx
    logs = fx.access_logs(spark, "/root/testdata/sf0.001")
    lazy = families.build(spark, logs, family)
    mat = families.build(spark, logs, family, materialize=True)
    assert lazy.keys() == mat.keys()
    for name in lazy:
        assert diff_rows(lazy[name], mat[name]).count() == 0, (family, name)
