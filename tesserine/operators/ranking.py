"""Row numbers and capped groups that hold at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.scratch import ensure_checkpoints

_LOCAL = (1 << 33) - 1


def numbered(df: DataFrame, order: list[Column | str], name: str = "n") -> DataFrame:
    """df with consecutive numbers from 0 in the given order.

    Rows are range-partitioned and sorted in their partition; a prefix sum over the
    partitions' counts, a row a partition, gives each its offset. No task sees all rows.
    The placed rows are checkpointed: counts and rows must come of the same ranges, and these
    are drawn from a sample anew each time that the plan runs.
    """
    ensure_checkpoints(df.sparkSession)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part, local = F.shiftright("__id", 33), F.col("__id").bitwiseAND(_LOCAL)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__count"))
    before = F.sum("__count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.withColumn("__part", part).join(offsets, "__part").withColumn(name, local + F.col("__before")).drop("__id", "__part", "__before")


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; Spark prunes the window by group limits."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", number).where(F.col("__n") <= n).drop("__n")
