"""Rows in ranges of a global order, so that no window runs over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..llm.common import shared_folder, shuffle_parts, stored


def in_ranges(df: DataFrame, *order_by: str) -> DataFrame:
    """``df`` and _part, the number of the row's range; equal keys share a range. The bounds are drawn anew whenever the rows are
    dealt, so they are dealt once and stored."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_parts(spark), *order_by).withColumn("_part", F.spark_partition_id())
    return stored(ranged, shared_folder(spark, "ranges"))
