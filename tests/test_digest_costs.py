"""What digests cost: no shuffle by texts or by missing urls, and announcements classified once."""

from __future__ import annotations

from pyspark.sql import functions as F

from bulletinlake.operators import sentences
from bulletinlake.plans import notice_queries


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_digest_lines_hold_no_rows_in_a_shuffle(spark, sf):
    plan = _plan(notice_queries.digest_lines(spark, sf))
    assert not any(x in plan for x in ("Exchange hashpartitioning", "ObjectHashAggregate", "SortMergeJoin", "Window"))


def test_blocks_without_urls_are_no_hot_key(spark):
    blocks = sentences.digest_blocks(spark.createDataFrame([(1, "# a\nx\n## b\n- [D-1] t (원문: https://a/1)\ny"), (2, None), (None, "# c")], "id long, text string"), "id", "text")
    assert [(r.id, r.pos, r.section, r.kind, r.url) for r in blocks.orderBy("id", "pos").collect()] == [
        (1, 0, "a", "section", None), (1, 1, "a", "prose", None), (1, 2, "b", "section", None), (1, 3, "b", "item", "https://a/1"), (1, 4, "b", "prose", None)
    ]
    many = spark.range(4000).select("id", F.lit(0).alias("pos"), F.lit(None).cast("string").alias("url"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = sentences.prune_dead(many, spark.createDataFrame([("https://a/1",)], "url string"), "id", "url")
        sizes = [r.n for r in kept.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_announcements_are_classified_once(spark, sf):
    plan = _plan(notice_queries.digest_composed(spark, sf))
    assert "documents.parquet" not in plan and "rlike" not in plan.lower()
