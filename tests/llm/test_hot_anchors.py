from __future__ import annotations

from pyspark.sql import functions as F

from cohortspark.llm import substring_dedup


def test_an_anchor_that_fills_a_shard_is_hot(spark):
    """24,000 unlike segments that share an anchor: 1.5 MB and more for one shard of 1 MB."""
    passage = "a passage that very many documents have at their beginnings; "
    rows = spark.range(24_000).select(
        F.col("id").alias("doc"),
        F.concat(F.lit(passage), F.sha2(F.col("id").cast("string"), 256)).alias("text"),
    )
    rows = rows.select("doc", F.xxhash64("text").alias("tie"), "text")
    assert len(substring_dedup._hot_anchors(rows, substring_dedup.HOT_ROWS)) > 0
