import datetime as dt

from tests.fixtures_data import cleaned
from weblog.operators import errors, hosts, ranking, temporal, traffic


def _by_key(df, key):
    return {getattr(r, key): r for r in df.collect()}


def test_host_profile_fixture(spark):
    p = _by_key(traffic.host_profile(cleaned(spark)), "client_ip")
    a = p["10.0.0.1"]
    assert (a.total_requests, a.total_bytes, a.average_bytes, a.error_rate, a.distinct_endpoints) \
        == (2, 100, 100.0, 50.0, 2)
    b = p["10.0.0.2"]
    assert (b.total_requests, b.total_bytes, b.average_bytes, b.error_rate) == (1, 7, 7.0, 100.0)
    c = p["10.0.0.4"]
    assert (c.total_bytes, c.error_rate, c.distinct_endpoints) == (9, 0.0, 1)


def test_null_bytes_as_zero(spark):
    p = _by_key(traffic.host_profile(cleaned(spark), null_bytes_as_zero=True), "client_ip")
    assert p["10.0.0.1"].average_bytes == 50.0


def test_all_null_bytes_host_ranks_last(spark):
    df = spark.createDataFrame(
        [("h1", None, 200, "/a"), ("h1", None, 200, "/b"), ("h2", 5, 200, "/a")],
        "client_ip string, response_bytes long, status_code int, request_path string")
    prof = traffic.host_profile(df)
    rows = ranking.rank_by(prof, "average_bytes", "client_ip").collect()
    assert [r.client_ip for r in rows] == ["h2", "h1"]
    assert rows[1].total_bytes is None and rows[1].average_bytes is None


def test_single_metrics_equal_fused(spark):
    logs = cleaned(spark)
    fused = _by_key(traffic.host_profile(logs), "client_ip")
    for fn, col in [(traffic.requests, "total_requests"), (traffic.total_bytes, "total_bytes"),
                    (traffic.avg_bytes, "average_bytes"), (traffic.error_rate, "error_rate"),
                    (traffic.distinct_paths, "distinct_endpoints"),
                    (traffic.distinct_pairs, "distinct_endpoints")]:
        single = _by_key(fn(logs), "client_ip")
        assert {k: getattr(v, col) for k, v in single.items()} == \
               {k: getattr(v, col) for k, v in fused.items()}, col


def test_join_forms(spark):
    logs = cleaned(spark)
    j = _by_key(traffic.error_rate_by_join(logs), "client_ip")
    assert j["10.0.0.4"].error_requests == 0 and j["10.0.0.4"].error_rate == 0.0
    assert j["10.0.0.1"].error_rate == 50.0
    a = _by_key(traffic.avg_bytes_by_join(logs), "client_ip")
    assert a["10.0.0.1"].average_bytes == 100.0


def test_hourly_and_daily(spark):
    h = _by_key(temporal.hourly_profile(cleaned(spark)), "hour")
    assert (h[0].total_requests, h[0].total_bytes, h[0].average_bytes, h[0].error_rate) == (2, 109, 54.5, 0.0)
    assert (h[23].total_requests, h[23].total_bytes, h[23].average_bytes, h[23].error_rate) == (2, 7, 7.0, 100.0)
    d = _by_key(temporal.daily_counts(cleaned(spark)), "date")
    assert {k: v.total_requests for k, v in d.items()} == {dt.date(2019, 1, 21): 2, dt.date(2019, 1, 22): 2}


def test_error_paths_tie_ordered_by_path(spark):
    rows = errors.top_paths(cleaned(spark)).collect()
    assert [(r.request_path, r["count"]) for r in rows] == [("/b", 1), ("/c d", 1)]


def test_status_rates_use_all_requests(spark):
    rows = errors.status_rates(cleaned(spark)).collect()
    assert [(r.status_code, r["count"], r.frequency) for r in rows] == [(404, 1, 0.25), (500, 1, 0.25)]


def test_grouping_sets(spark):
    rows = errors.path_status_rollup(cleaned(spark)).collect()
    got = {(r.level, r.request_path, r.status_code, r["count"]) for r in rows}
    assert got == {("path", "/b", None, 1), ("path", "/c d", None, 1),
                   ("status", None, 404, 1), ("status", None, 500, 1)}


def test_no_errors_gives_empty_reports(spark):
    logs = cleaned(spark).where("status_code < 400")
    assert errors.top_paths(logs).count() == 0
    assert errors.status_rates(logs).count() == 0


def test_empty_table_aggregates(spark):
    logs = cleaned(spark).where("false")
    assert traffic.host_profile(logs).count() == 0
    assert temporal.hourly_profile(logs).count() == 0


def test_top_n_deterministic_ties(spark):
    df = spark.createDataFrame([(f"h{i}", 1) for i in range(20)], "client_ip string, n int")
    rows = ranking.top_n(df, "n", "client_ip", 3).collect()
    assert [r.client_ip for r in rows] == ["h0", "h1", "h10"]


def test_label_hosts_fallback(spark):
    prof = traffic.host_profile(cleaned(spark))
    d = spark.createDataFrame([("10.0.0.1", "alpha"), ("10.0.0.1", "beta")],
                              "client_ip string, hostname string")
    out = _by_key(hosts.label_hosts(prof, d), "client_ip")
    assert len(out) == 3
    assert out["10.0.0.1"].hostname == "alpha" and out["10.0.0.2"].hostname == "10.0.0.2"
