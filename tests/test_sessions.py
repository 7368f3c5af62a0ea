
from datetime import timedelta

from pyspark.sql import functions as F

from tests.fixtures_data import T0, cleaned, session_df
from weblog.operators import sessions as S
from tools.inspect_plan import exchanges


def _sessions(df):
    return sorted((r.client_ip, r.session_id, r.request_count, r.duration_secs) for r in df.collect())


def test_boundaries_and_ties(spark):
    assert _sessions(S.sessions(session_df(spark))) == [
        ("a", 1, 2, 1800), ("a", 2, 3, 1799), ("b", 1, 1, 0)]


def test_per_host(spark):
    per = {r.client_ip: r for r in S.per_host(S.sessions(session_df(spark))).collect()}
    assert (per["a"].session_count, per["a"].avg_duration_secs, per["a"].avg_requests_per_session) == (2, 1799.5, 2.5)
    assert (per["b"].session_count, per["b"].avg_duration_secs, per["b"].avg_requests_per_session) == (1, 0.0, 1.0)


def test_fixture_lines_gap_exactly_timeout(spark):
    assert _sessions(S.sessions(cleaned(spark))) == [
        ("10.0.0.1", 1, 2, 1800), ("10.0.0.2", 1, 1, 0), ("10.0.0.4", 1, 1, 0)]
    assert _sessions(S.sessions(cleaned(spark), timeout=1799)) == [
        ("10.0.0.1", 1, 1, 0), ("10.0.0.1", 2, 1, 0), ("10.0.0.2", 1, 1, 0), ("10.0.0.4", 1, 1, 0)]


def test_row_columns(spark):
    rows = sorted(S.session_rows(session_df(spark)).collect(), key=lambda r: (r.client_ip, r.log_ts, r.gap_secs or -1))
    got = [(r.client_ip, (r.log_ts - T0).seconds, r.gap_secs, r.is_new_session, r.session_id) for r in rows]
    assert got == [("a", 0, None, 1, 1), ("a", 1800, 1800, 0, 1), ("a", 3601, 0, 0, 2),
                   ("a", 3601, 1801, 1, 2), ("a", 5400, 1799, 0, 2), ("b", 10, None, 1, 1)]


def test_assign_ids_equal_row_form(spark):
    df = session_df(spark)
    a = sorted((r.client_ip, r.log_ts, r.session_id) for r in S.assign_session_ids(df).collect())
    b = sorted((r.client_ip, r.log_ts, r.session_id) for r in S.session_rows(df).collect())
    assert a == b


def test_zero_timeout(spark):
    ev = [("a", 0), ("a", 0), ("a", 1), ("a", 3)]
    assert _sessions(S.sessions(session_df(spark, ev), timeout=0)) == [
        ("a", 1, 2, 0), ("a", 2, 1, 0), ("a", 3, 1, 0)]


def _brute_force(events, timeout):
    """Reference semantics by a plain loop over each key's sorted timestamps."""
    out = []
    by = {}
    for k, s in events:
        by.setdefault(k, []).append(s)
    for k, ts in by.items():
        ts.sort()
        sid, start, prev, n = 0, None, None, 0
        for t in ts:
            if prev is None or t - prev > timeout:
                if prev is not None:
                    out.append((k, sid, n, prev - start))
                sid, start, n = sid + 1, t, 0
            n += 1
            prev = t
        out.append((k, sid, n, prev - start))
    return sorted(out)


def test_matches_brute_force_random(spark):
    import random
    rnd = random.Random(7)
    events = [(f"k{rnd.randint(0, 4)}", rnd.randint(0, 20000)) for _ in range(400)]
    for timeout in (1, 60, 300, 1800):
        got = _sessions(S.sessions(session_df(spark, events), timeout=timeout))
        assert got == _brute_force(events, timeout), timeout
        w = sorted((r.client_ip, r.request_count, r.duration_secs)
                   for r in S.sessions_by_window(session_df(spark, events), timeout=timeout).collect())
        assert w == sorted((k, n, d) for k, _, n, d in _brute_force(events, timeout)), timeout


def test_hot_key_bounded_summary(spark):
    # One key with many requests inside a few buckets: the summary stays small.
    events = [("hot", i % 7200) for i in range(20000)] + [("cold", 5)]
    df = session_df(spark, events)
    assert S.bucket_summary(df).where(F.col("client_ip") == "hot").count() == 4
    assert _sessions(S.sessions(df)) == [("cold", 1, 1, 0), ("hot", 1, 20000, 7199)]


def test_nested_roundtrip(spark):
    s = S.sessions(session_df(spark))
    nested = S.nested_sessions(s)
    assert dict((r.client_ip, len(r.sessions)) for r in nested.collect()) == {"a": 2, "b": 1}
    assert _sessions(S.flatten_sessions(nested)) == _sessions(s)


def test_no_exchange_on_raw_rows_by_client_alone(spark):
    # The raw rows are shuffled on (client, bucket) after a partial aggregate;
    # only the small bucket summary is shuffled on the client key.
    ex = exchanges(S.sessions(session_df(spark)))
    assert len(ex) == 2, ex
    first, second = sorted(ex, key=len, reverse=True)
    assert first.count("#") == 2          # (client, bucket): raw rows, after partial aggregation
    assert second.startswith("hashpartitioning(client_ip")  # the bucket summary only


def test_session_bounds_and_nested(spark):
    s = S.sessions(session_df(spark), with_bounds=True)
    rows = {(r.client_ip, r.session_id): r for r in s.collect()}
    a2 = rows[("a", 2)]
    assert ((a2.session_start - T0).seconds, (a2.session_end - T0).seconds) == (3601, 5400)
    nested = {r.client_ip: r.sessions for r in S.nested_sessions(s).collect()}
    assert nested["a"][1].session_end == a2.session_end


def test_short_timeouts_in_chunks_match_brute_force(spark, monkeypatch):
    import random
    monkeypatch.setattr(S, "CHUNK", 5)
    rnd = random.Random(9)
    events = [(f"k{rnd.randint(0, 3)}", rnd.randint(0, 300)) for _ in range(300)] + [(None, t) for t in (0, 1, 50)]
    df = session_df(spark, events)
    for timeout in (0, 1, 3, 59):
        want = _brute_force([(k or "", t) for k, t in events], timeout)
        assert sorted((r.client_ip or "", r.session_id, r.request_count, r.duration_secs)
                      for r in S.sessions(df, timeout=timeout).collect()) == want, timeout
        rows = S.session_rows(df, timeout=timeout).collect()
        ids = {(k, i): n for k, i, n, _ in want}
        got = {}
        for r in rows:
            at = (r.client_ip or "", r.session_id)
            got[at] = got.get(at, 0) + 1
            assert r.gap_secs is None or r.is_new_session == int(r.gap_secs > timeout)
        assert got == ids


def test_window_in_chunks(spark, monkeypatch):
    # Short chunks, so that sessions end, begin and go on at their borders, and span several.
    import random
    rnd = random.Random(11)
    events = [(rnd.choice(["a", "b", None]), rnd.randint(0, 900)) for _ in range(150)] + [("c", i) for i in range(0, 300, 3)]
    df = session_df(spark, events)
    for chunk in (1 << 16, 7, 1):
        monkeypatch.setattr(S, "WINDOW_SECONDS", chunk)
        for timeout in (1, 3, 20):
            want = S.sessions(df, timeout=timeout, with_bounds=True).collect()
            want = sorted(((r.client_ip or "", r.session_start, r.session_end, r.request_count, r.duration_secs) for r in want))
            got = [(r.client_ip or "", r.session_start, r.session_end - timedelta(seconds=timeout), r.request_count, r.duration_secs)
                   for r in S.sessions_by_window(df, timeout=timeout).collect()]
            assert sorted(got) == want, (chunk, timeout)
    # No session window takes all of a client's seconds.
    dealt = [e for e in exchanges(S.sessions_by_window(df)) if "client_ip" in str(e)]
    assert dealt and all(any(x in str(e) for x in ("_chunk", "_inner", "_sec", "_groupingexpression")) for e in dealt), dealt


def test_gaps_of_a_client_with_half_of_all_rows_in_one_long_bucket(spark):
    import random
    rnd = random.Random(5)
    timeout = 6 * 3600
    hot = [("hot", rnd.randrange(timeout)) for _ in range(6000)] + [("hot", 20 * timeout), ("hot", 9 * timeout + 7)]
    events = hot + [(f"k{rnd.randint(0, 300)}", rnd.randrange(10 * timeout)) for _ in range(6000)]
    df = session_df(spark, events)
    rows = S.session_rows(df, timeout=timeout)
    # What the window over rows groups by: whole minutes of a client, dealt evenly.
    keyed = S._keyed(df, "client_ip", "log_ts", S.ROW_BUCKET).where("log_ts IS NOT NULL")
    parts = sorted(r["count"] for r in keyed.repartition(16, "_key", "_bucket").groupBy(F.spark_partition_id()).count().collect())
    assert len(parts) == 16 and parts[-1] <= 3 * parts[8], parts
    assert keyed.groupBy("_key", "_bucket").count().agg(F.max("count")).first()[0] < 60
    by = {}
    for k, t in events:
        by.setdefault(k, []).append(t)
    want = []
    for k, ts in by.items():
        ts.sort()
        sid = 0
        for i, t in enumerate(ts):
            gap = t - ts[i - 1] if i else None
            sid += gap is None or gap > timeout
            want.append((k, t, -1 if gap is None else gap, int(gap is None or gap > timeout), sid))
    got = [(r.client_ip, int((r.log_ts - T0).total_seconds()), -1 if r.gap_secs is None else r.gap_secs, r.is_new_session, r.session_id)
           for r in rows.collect()]
    assert sorted(got) == sorted(want)
