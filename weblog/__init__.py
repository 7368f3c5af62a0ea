"""weblog: web-server access-log analytics as lazy Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL's own
expressions (no UDFs, no driver-side collection), correct under ANSI mode.

Layout:
    weblog.session     SparkSession builder (UTC, AQE, ANSI on)
    weblog.schema      canonical access-log schema and ``conform``
    weblog.functions   column expressions: log-line pattern, error predicate, rates
    weblog.sources     readers and writers (text, gzip, Parquet, JSON payloads,
                       Spark event logs)
    weblog.operators   parse, clean, quality, errors, traffic, temporal, sessions,
                       ranking, hosts, metrics, checks, families
    weblog.plans       SQL surface (one SQL text per family) and plan inspection
    weblog.streaming   incremental (file-stream) form of the ingest job
    weblog.fixtures    access-log shaped views of the driver's test tables
"""

__version__ = "0.1.0"
