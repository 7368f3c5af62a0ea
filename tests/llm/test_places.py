"""Rows are told apart by their place: null and repeated ids, exploded and joined frames."""
from pyspark.sql import functions as F

from weblog.llm import common, exact_dedup, near_dedup

SF = "/root/testdata/sf0.001"


def test_places_of_a_scan_and_of_other_frames(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert common._plain_scan(docs.where("doc_id > 3").select("text"))
    for frame in (docs, docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")), docs.crossJoin(spark.range(2)),
                  docs.unionByName(docs), docs.limit(5), spark.range(5).selectExpr("id AS doc_id", "'x' AS text")):
        rows = common.placed(frame)
        assert rows.select("file", "row").distinct().count() == rows.count() == frame.count()
        assert rows.columns == [f"c{i}" for i in range(len(frame.columns))] + ["file", "row"]


def test_copies_of_an_exploded_frame(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 20")
    one = docs.select(F.regexp_replace("text", r"[\x20\x09-\x0D]", "")).distinct().count()
    twice = docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("turn"))
    assert exact_dedup.unique(twice).count() == one
    assert exact_dedup.unique(docs.crossJoin(spark.range(2))).count() == one
    near = near_dedup.unique(docs).count()
    assert near_dedup.unique(twice).count() == near <= one


def test_two_thousand_rows_without_id(spark):
    rows = spark.range(2000).selectExpr(
        "cast(null AS long) AS doc_id",
        "concat_ws(' ', transform(sequence(0, 30), i -> concat('w', (id div 2) * 31 + i)), if(id % 2 = 0, '', 'more')) AS text")
    found = near_dedup._grouped(near_dedup.located(rows).select("doc_id", "text", "file", "row"), 5, 80, 2)
    assert found.select("root").distinct().count() == 1000
    assert near_dedup.unique(rows).count() == 1000
    assert exact_dedup.unique(rows.unionByName(rows)).count() == 2000
