"""Access-log shaped views of the driver's test tables.

``events`` is projected to the access-log schema by SQL that runs unchanged on
Spark and DuckDB (``{STR}`` is the engine's string type name). ``raw_lines``
renders the same rows as Combined Log lines, so that parse and clean can be
checked against the projection itself.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.session import ensure_utc

# Projection of events(event_id, ts, user_id, event_type, value, props).
# ``{method}`` is the method expression, so the strict-method variant can
# introduce a verb outside the allow-list.
_PROJECTION = """
SELECT {client} AS client_ip,
       date_trunc('second', ts) AS log_ts,
       {method} AS http_method,
       concat('/', event_type, '/', regexp_extract(props, '([0-9]+)', 1)) AS request_path,
       'HTTP/1.1' AS http_version,
       CAST(CASE WHEN event_type = 'error'
                 THEN CASE WHEN user_id % 3 = 0 THEN 500 WHEN user_id % 3 = 1 THEN 404 ELSE 403 END
                 WHEN event_type = 'signup' THEN 201 ELSE 200 END AS INT) AS status_code,
       CASE WHEN event_type = 'signup' THEN NULL
            ELSE CAST(floor(value * 100) AS BIGINT) END AS response_bytes,
       CAST(ts AS DATE) AS log_date{extra}
FROM {events}
"""
_METHOD = "CASE WHEN event_type IN ('purchase','signup') THEN 'POST' ELSE 'GET' END"
# Strict variant: every user whose id ends in 7 sends an unknown verb.
_METHOD_STRICT = (
    "CASE WHEN user_id % 10 = 7 THEN 'FOO' "
    "WHEN event_type IN ('purchase','signup') THEN 'POST' ELSE 'GET' END"
)


# Hot-client variant: every third user shares one client address, so one
# client holds about a third of all requests (the skew case).
_CLIENT = "CAST(user_id AS {STR})"
_CLIENT_HOT = "CASE WHEN user_id % 3 = 0 THEN 'hot' ELSE CAST(user_id AS {STR}) END"
# Null variant: every fifth user's requests have no client address.
_CLIENT_NULL = "CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id AS {STR}) END"


def projection_sql(engine: str = "spark", events: str = "events",
                   strict_methods: bool = False, with_event_id: bool = False,
                   hot_client: bool = False, null_clients: bool = False) -> str:
    """The projection as SQL text for ``engine`` in {"spark", "duckdb"}."""
    client = _CLIENT_HOT if hot_client else _CLIENT_NULL if null_clients else _CLIENT
    string = "STRING" if engine == "spark" else "VARCHAR"
    return _PROJECTION.format(
        client=client.format(STR=string),
        STR=string,
        method=_METHOD_STRICT if strict_methods else _METHOD,
        extra=", event_id" if with_event_id else "",
        events=events,
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; pins the session zone to UTC (dates and hours are UTC)."""
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def access_logs(spark: SparkSession, sf_dir: str, strict_methods: bool = False,
                with_event_id: bool = False, hot_client: bool = False,
                null_clients: bool = False) -> DataFrame:
    """The ``events`` table in access-log shape (canonical columns, UTC)."""
    ensure_utc(spark)
    ev = table(spark, sf_dir, "events")
    return spark.sql(
        projection_sql("spark", "{events}", strict_methods, with_event_id, hot_client, null_clients), events=ev)


def line_of(name: str = "value") -> Column:
    """A row of ``access_logs`` as a Combined Log line."""
    return F.concat(
        F.col("client_ip"), F.lit(" - - ["),
        F.date_format("log_ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000] \""),
        F.col("http_method"), F.lit(" "), F.col("request_path"), F.lit(" "),
        F.col("http_version"), F.lit("\" "),
        F.col("status_code").cast("string"), F.lit(" "),
        F.coalesce(F.col("response_bytes").cast("string"), F.lit("-")),
    ).alias(name)


def raw_lines(spark: SparkSession, sf_dir: str, malformed: bool = False,
              strict_methods: bool = False) -> DataFrame:
    """``events`` rendered as Combined Log lines in a single ``value`` column.

    ``malformed=True`` cuts every hundredth line (``event_id % 100 = 0``) short,
    so that it no longer matches the line pattern.
    """
    logs = access_logs(spark, sf_dir, strict_methods=strict_methods, with_event_id=True)
    line = line_of()
    if malformed:
        line = F.when(F.col("event_id") % 100 == 0, F.substring(line, 1, 20)).otherwise(line)
    return logs.select(line.alias("value"))


#: Kinds of lines in ``variant_lines``, dealt by ``event_id`` modulo their number.
VARIANTS = ("plain", "east", "west", "two_fields", "three_fields", "status_099", "status_600", "bad_month",
            "two_tokens", "lower_verb", "padded_path", "no_version", "cut")


def variant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as log lines of all kinds in ``VARIANTS``, so that every parsing and cleaning rule has a
    line that only it decides: other zones, two and three trailing quoted fields, a status below
    and above the range, a month that is none, a request without version, one in lower case, one padded, one
    with a version that is blank but for itself, and a line cut short."""
    logs = access_logs(spark, sf_dir, with_event_id=True)
    kind = F.element_at(F.array(*[F.lit(v) for v in VARIANTS]), (F.col("event_id") % len(VARIANTS) + 1).cast("int"))
    is_ = lambda v: kind == v
    minutes = F.when(is_("east"), 210).when(is_("west"), -480).otherwise(0)
    shifted = F.timestamp_seconds(F.unix_timestamp("log_ts") + minutes * 60)
    stamp = F.when(is_("bad_month"), F.date_format(shifted, "dd/'Foo'/yyyy:HH:mm:ss")).otherwise(
        F.date_format(shifted, "dd/MMM/yyyy:HH:mm:ss"))
    zone = F.when(is_("east"), " +0330").when(is_("west"), " -0800").otherwise(" +0000")
    verb = F.when(is_("lower_verb"), F.lower("http_method")).otherwise(F.col("http_method"))
    path = F.when(is_("padded_path"), F.concat(F.lit(" "), "request_path", F.lit("  "))).otherwise(F.col("request_path"))
    request = F.when(is_("two_tokens"), F.concat_ws(" ", verb, path)).otherwise(
        F.concat_ws(" ", verb, path, F.when(is_("no_version"), "-").otherwise(F.col("http_version"))))
    status = F.when(is_("status_099"), "099").when(is_("status_600"), "600").otherwise(F.col("status_code").cast("string"))
    more = F.when(is_("two_fields"), ' "http://from/" "agent 1.0"').when(
        is_("three_fields"), ' "http://from/" "agent 1.0" "-"').otherwise("")
    line = F.concat("client_ip", F.lit(" - - ["), stamp, zone, F.lit('] "'), request, F.lit('" '), status, F.lit(" "),
                    F.coalesce(F.col("response_bytes").cast("string"), F.lit("-")), more)
    return logs.select(F.when(is_("cut"), F.substring(line, 1, 20)).otherwise(line).alias("value"))


def host_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host dimension (client_ip, hostname): all customers."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").cast("string").alias("client_ip"),
        F.col("c_name").alias("hostname"),
    )


# --- measurement tables derived from the TPC-H-like tables -------------------

def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records from ``lineitem``: query = returnflag, api = linestatus,
    scale_pct = linenumber, elapsed_sec = extendedprice."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.lit("lineitem").alias("benchmark_id"),
        F.col("l_linenumber").alias("scale_pct"),
        F.col("l_returnflag").alias("query"),
        F.col("l_linestatus").alias("api"),
        F.col("l_orderkey").alias("run"),
        F.col("l_extendedprice").alias("elapsed_sec"),
    )


def keyed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records with a unique run key, from ``orders``."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.year("o_orderdate").cast("string").alias("benchmark_id"),
        F.month("o_orderdate").alias("scale_pct"),
        F.col("o_orderstatus").alias("query"),
        F.col("o_orderpriority").alias("api"),
        F.col("o_orderkey").alias("run"),
        F.col("o_totalprice").alias("elapsed_sec"),
    )


def payload_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records grouped into small benchmarks: one benchmark per (order, supplier)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"),
                    F.col("l_suppkey").cast("string")).alias("benchmark_id"),
        F.lit(100).alias("scale_pct"),
        F.col("l_returnflag").alias("query"),
        F.col("l_linestatus").alias("api"),
        F.col("l_partkey").alias("run"),
        F.col("l_extendedprice").alias("elapsed_sec"),
    )


def stage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage records from ``lineitem`` (one stage per line item)."""
    li = table(spark, sf_dir, "lineitem")
    fl = lambda c: F.floor(c).cast("bigint")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string")).alias("stage_id"),
        F.col("l_linenumber").alias("scale_pct"),
        F.col("l_returnflag").alias("query"),
        F.col("l_linestatus").alias("api"),
        F.col("l_shipdate").alias("submitted"),
        fl(F.col("l_quantity")).alias("num_tasks"),
        fl(F.col("l_extendedprice") * 100).alias("shuffle_read_bytes"),
        fl(F.col("l_extendedprice") * F.col("l_discount") * 100).alias("shuffle_write_bytes"),
        fl(F.col("l_tax") * 1000).alias("disk_bytes_spilled"),
        fl(F.col("l_quantity") * 10).alias("executor_deserialize_time"),
        fl(F.col("l_extendedprice") * 1000000).alias("executor_cpu_time"),
    )
