"""Distributed global ranking (1..N in a total order) without a
single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.functions.lineage import materialize


def global_rank(df: DataFrame, order: list[Column], rank_col: str = "rank") -> DataFrame:
    """Dense 1..N position of every row in ``order`` (which must be a total
    order, i.e. end in a unique key).

    The range-partitioned sort runs once, and its rows are stored with the
    number of their partition and their place in it. Both the per-partition
    counts and the ranked rows are read from those files: sorting twice could
    cut the partitions differently, and rows would be lost or share a rank.
    The offsets table has one row per sorted partition, whatever the data."""
    mid = F.monotonically_increasing_id()       # (partition id << 33) + place in the partition
    stored = materialize(df.orderBy(*order).withColumn("_pid", F.shiftright(mid, 33)).withColumn("_mid", mid), "ranked")
    stored = stored.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), 33)).drop("_mid")
    per_part = stored.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (stored.join(F.broadcast(offsets), "_pid")
                  .withColumn(rank_col, (F.col("_offset") + F.col("_local") + 1).cast("bigint"))
                  .drop("_pid", "_local", "_offset"))
