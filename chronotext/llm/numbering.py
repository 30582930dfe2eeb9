"""Positions of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotext.llm.common import Scratch


def numbered(rows: DataFrame, group: str, order: list[Column], scratch: Scratch, out: str = "i",
             total: str = "n") -> DataFrame:
    """Add ``out``, the position from 0 of a row within its group (not null) in the given order, and ``total``, the
    size of the group.

    Rows are range-partitioned by group and order and stored with the number of their partition, so a repeated task
    can't move one. Counts per group and partition give where each partition's share of a group begins; a group that
    holds all rows is numbered in as many tasks as there are partitions. Fully equal rows may take either place.
    """
    part = rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id())
    part = scratch.write(part, "ranges")
    shares = part.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = scratch.write(shares.select(
        group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"),
        F.sum("_n").over(Window.partitionBy(group)).alias(total)), "shares")
    here = Window.partitionBy(group, "_part").orderBy(*order)
    placed = part.withColumn("_rn", F.row_number().over(here) - 1)
    return placed.join(shares, [group, "_part"]).withColumn(out, F.col("_first") + F.col("_rn")).drop(
        "_part", "_first", "_rn")
