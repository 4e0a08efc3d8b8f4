"""Consecutive numbers over a whole table without one task seeing it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeflow.functions.scalars import floor_div

#: How many ranges share a parent range, and so the most rows one prefix sum reads.
FAN_BITS = 16


def _starts(sizes: DataFrame, bits: int) -> DataFrame:
    """``_range, _start`` from ``_range, _n``: how many rows stand in all ranges before.

    ``bits`` bounds the range numbers. Sums run among ranges of one parent, parents take theirs
    from their own parents, so no task reads more than ``2 ** FAN_BITS`` sizes.
    """
    if bits <= FAN_BITS:
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    parent = floor_div(F.col("_range"), 1 << FAN_BITS)
    within = (
        Window.partitionBy("_parent").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sizes.withColumn("_parent", parent).withColumn(
        "_before", F.coalesce(F.sum("_n").over(within), F.lit(0))
    )
    parents = sizes.groupBy(parent.alias("_range")).agg(F.sum("_n").alias("_n"))
    above = _starts(parents, bits - FAN_BITS).select(F.col("_range").alias("_parent"), "_start")
    return local.join(above, "_parent").select(
        "_range", (F.col("_start") + F.col("_before")).alias("_start")
    )


def dense_positions(df: DataFrame, order: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Add ``name``: 0, 1, 2 … by the whole number ``order`` (ties in any order).

    Rows are numbered inside ranges of ``order``. Range sizes add up level by level, so sparse
    numbers, where every row is a range of its own, spread over tasks like dense ones.
    """
    rows = df.withColumn("_range", floor_div(F.col(order), width))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = _starts(sizes, 65 - width.bit_length())
    inside = Window.partitionBy("_range").orderBy(order)
    return (
        rows.join(starts, "_range")
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_range", "_start")
    )
