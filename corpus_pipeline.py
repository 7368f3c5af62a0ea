"""Corpus preparation: each stage reads what its predecessor kept.

``run`` writes every stage's result as Parquet in the shared checkpoint folder and
rereads it as the next stage's documents. All stages but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblog.llm import bpe, exact_dedup, mixing, near_dedup, quality
from weblog.llm.common import pick, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return pick(docs, **{c: c for c in COLUMNS})


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality score reaches ``quality.KEEP``; without labels, all."""
    rows = written(quality.described_rows(_documents(docs)), "quality-statistics")
    model = quality.fit(rows.select("doc_id", F.col("x_").alias("x")), table(spark, sf_dir, "labels"))
    return quality.scored_rows(rows, model).where(F.col("score_") >= quality.KEEP).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest original with the smallest doc_id stays."""
    return _documents(exact_dedup.unique(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 stays."""
    return near_dedup.unique(_documents(docs), n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row for each time a document is taken, in the mix's order."""
    return mixing.shuffled(mixing.mixed(_documents(docs))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, with digests of the ids and of what they decode to."""
    return bpe.tokenize(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Learned scores, sketches and random draws: no SQL states the whole; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
