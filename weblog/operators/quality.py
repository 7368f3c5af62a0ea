"""Parse-quality statistics of an ingest, as one aggregate over the parsed lines."""
from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weblog.functions.exprs import ratio
from weblog.operators.clean import keep_mask


def _counts(strict_http_method: bool):
    return [
        F.count(F.lit(1)).alias("raw_lines"),
        F.count_if(F.col("line_matched")).alias("matched_lines"),
        F.count_if(keep_mask(strict_http_method)).alias("cleaned_lines"),
    ]


def parse_quality(parsed: DataFrame, strict_http_method: bool = False) -> DataFrame:
    """One row: raw, matched and cleaned line counts; match rate and parse rate.

    Rates are fractions of the raw lines, null for an empty input. One scan
    replaces three cached counts.
    """
    c = parsed.agg(*_counts(strict_http_method))
    return c.select(
        "raw_lines", "matched_lines", "cleaned_lines",
        ratio(F.col("matched_lines"), F.col("raw_lines")).alias("match_rate"),
        ratio(F.col("cleaned_lines"), F.col("raw_lines")).alias("parse_rate"),
    )


def observed(parsed: DataFrame, strict_http_method: bool = False,
             name: str = "parse_quality") -> tuple[DataFrame, Observation]:
    """Attach the same counts as an ``Observation`` so that a later write
    collects them in the same job (no extra pass over the data).

    The counts are exact when the observed frame is evaluated in the stage that
    writes (no shuffle between it and the sink): Spark applies each result
    task's update once. Behind a shuffle, a re-run map stage may count twice;
    use ``parse_quality`` there.
    """
    obs = Observation(name)
    return parsed.observe(obs, *_counts(strict_http_method)), obs
