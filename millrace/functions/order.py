"""Positions in a global order without one task that holds everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def with_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds each row's place (from 0) in the order of the given columns.

    A range sort, one count a partition, and offsets over those counts; the
    sort is cut because a second run could draw other boundaries."""
    sorted_rows = cut(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_seq")))
    parts = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = sorted_rows.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_seq") - F.col("_first")).drop("_part", "_seq", "_n", "_first", "_before")
