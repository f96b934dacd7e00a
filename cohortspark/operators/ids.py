"""Dense ids 1..N in key order, without sorting the rows in one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspark.session import checkpointed

_ROW_BITS = (1 << 33) - 1


def rank_by_id(df: DataFrame, id_column: str, rank: str, bucket_rows: int = 1 << 20) -> DataFrame:
    """The 1-based position of each row in the order of a unique integer id.

    The id axis is cut in buckets of ``bucket_rows`` values, so no bucket can hold more rows than
    that. Rows are numbered inside their bucket, and each bucket starts after the rows of the
    buckets before it. Only the bucket counts, one row per bucket, are summed in one place. The
    cut depends on the id alone, so a recomputed task gives the same ranks.
    """
    bucket = F.floor(F.col(id_column) / F.lit(bucket_rows))
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_bucket").orderBy(id_column)
    return (
        df.withColumn("_bucket", bucket)
        .withColumn("_inside", F.row_number().over(inside))
        .join(starts, "_bucket")
        .withColumn(rank, F.col("_start") + F.col("_inside"))
        .drop("_bucket", "_inside", "_start")
    )


def rank_distinct(keys: DataFrame, columns: list[str], rank: str) -> DataFrame:
    """The dense rank of each distinct key, in code-point order with NULLs last.

    The distinct keys are range-partitioned and sorted, then written, because a second evaluation
    could sample other range bounds. The starts are one row per partition.
    """
    order = [F.col(c).asc_nulls_last() for c in columns]
    placed = checkpointed(
        keys.select(*columns)
        .distinct()
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_inside", F.monotonically_increasing_id().bitwiseAND(_ROW_BITS) + 1)
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    return placed.join(starts, "_part").select(
        *columns, (F.col("_start") + F.col("_inside")).alias(rank)
    )
