"""Consecutive numbers of rows in any order of columns, ties and repeated rows included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.llm.common import saved

#: ``monotonically_increasing_id`` holds the partition above this many bits.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str, keys: list[str] = []) -> DataFrame:
    """``df`` with the long ``name``: 0, 1, 2 … within ``keys``, by ``keys`` and then ``order``.

    Rows are dealt into ranges of that order and written sorted, so a row's place in its file is
    known; what is missing are the rows of its key in the files before, one number for each file
    and key. Rows equal in all of ``keys`` and ``order`` are told apart by where they were read, so
    a large group of them spreads over ranges, too; their numbers fall to them in any order. Nulls come
    first. ``keys`` hold no null. No rows give no rows.
    """
    by = [*keys, *order, "_tie"]
    # Written first: the bounds of ranges are sampled from the rows, which would be made twice.
    placed = saved(
        saved(df, "rows").withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .drop("_tie")
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    )
    placed = placed.withColumn("_part", F.shiftright("_at", ROW_BITS))
    runs = placed.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(
        *keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return (
        placed.join(starts, [*keys, "_part"])
        .withColumn(name, F.col("_at") + F.col("_shift"))
        .drop("_at", "_part", "_shift")
    )


def key_text(column: str) -> Column:
    """A text without nulls that sorts as ``column`` does with nulls first."""
    text = F.col(column).cast("string")
    return F.when(text.isNull(), "").otherwise(F.concat(F.lit("="), text))
