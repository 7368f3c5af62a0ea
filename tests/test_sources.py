from tests.fixtures_data import cleaned, lines_df
from tools.inspect_plan import plan_text
from weblog.sources import read_lines, read_logs, register_logs, sample_lines, verify_written, write_logs


def test_write_by_date_and_prune(spark, tmp_path):
    out = str(tmp_path / "t")
    write_logs(cleaned(spark), out, by_date=True)
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("log_date=")) == \
        ["log_date=2019-01-21", "log_date=2019-01-22"]
    one_day = read_logs(spark, out, date_from="2019-01-22", date_to="2019-01-22")
    assert one_day.count() == 2
    assert "PartitionFilters: [isnotnull(log_date" in plan_text(one_day)


def test_by_date_write_rebalance_option(spark, tmp_path):
    out = str(tmp_path / "t")
    write_logs(cleaned(spark), out, by_date=True, rebalance=True)
    assert read_logs(spark, out).count() == 4
    # The rebalance hint plans a RebalancePartitions node (AQE may split a hot date).
    df = cleaned(spark).hint("rebalance", "log_date")
    assert "RebalancePartitions" in plan_text(df, "extended")


def test_partitions_and_verify(spark, tmp_path):
    out = str(tmp_path / "t")
    write_logs(cleaned(spark), out, partitions=2)
    assert verify_written(spark, out) == 4
    assert len(list((tmp_path / "t").glob("part-*.parquet"))) <= 2


def test_verify_empty_raises(spark, tmp_path):
    import pytest
    out = str(tmp_path / "t")
    write_logs(cleaned(spark).where("false"), out)
    with pytest.raises(RuntimeError):
        verify_written(spark, out)


def test_read_columns_epoch(spark, tmp_path):
    out = str(tmp_path / "t")
    write_logs(cleaned(spark), out)
    df = read_logs(spark, out, columns=["client_ip", "log_ts"], epoch_seconds=True)
    assert df.schema["log_ts"].dataType.simpleString() == "bigint"
    assert "ReadSchema: struct<client_ip:string,log_ts:timestamp>" in plan_text(df)


def test_register_view(spark, tmp_path):
    out = str(tmp_path / "t")
    write_logs(cleaned(spark), out)
    register_logs(spark, out, "weblog_test_view")
    assert spark.sql("SELECT count(*) AS n FROM weblog_test_view").collect()[0].n == 4
    spark.catalog.dropTempView("weblog_test_view")


def test_read_lines_and_sample(spark, tmp_path):
    p = tmp_path / "a.log"
    p.write_text("a\nb\nc\n")
    lines = read_lines(spark, str(p), repartition=3)
    assert lines.rdd.getNumPartitions() == 3 and lines.count() == 3
    assert sample_lines(lines, 100.0) is lines
    assert sample_lines(lines, 0.0).count() == 0
    s1 = sample_lines(lines_df(spark, [str(i) for i in range(2000)]), 10.0, seed=1)
    s2 = sample_lines(lines_df(spark, [str(i) for i in range(2000)]), 10.0, seed=1)
    assert sorted(r.value for r in s1.collect()) == sorted(r.value for r in s2.collect())
    assert 100 < s1.count() < 320


def test_cluster_profile_keys():
    from weblog.session import CLUSTER_CONF
    assert CLUSTER_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "256m"
