"""Window helpers that do not put a hot key into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeflow.functions.scalars import floor_div

#: A key with more rows than this is cut into chunks. It also bounds the list of hot keys:
#: at most rows / HOT_ROWS of them can exist, about a million in 10^12 rows.
HOT_ROWS = 1 << 20


def previous_row(
    df: DataFrame,
    key: str,
    order: str,
    columns: Sequence[str],
    name: str = "prev",
    where: Column | None = None,
    hot_rows: int = HOT_ROWS,
    chunk_width: int | None = None,
) -> DataFrame:
    """Add ``name``: ``columns`` of the nearest earlier row of ``key`` (that satisfies ``where``).

    ``order`` is a unique whole number. A plain window sorts all rows of one key in one task.
    Here a key above ``hot_rows`` is cut between its smallest and largest ``order`` into as many
    equal ranges as ``chunk_width`` goes into its rows, so sparse numbers give no more ranges than
    dense ones. The window runs per range, and a range takes what it cannot see from the last
    fitting row of the ranges before.
    """
    width = chunk_width or hot_rows
    fits = F.lit(True) if where is None else where
    value = F.when(fits, F.struct(*columns))
    # Counting is pre-aggregated, so a hot key costs one small row per task.
    chunks = floor_div(F.col("_n") + width - 1, width)
    hot = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_from"), F.max(order).alias("_to"))
        .filter(F.col("_n") > hot_rows)
        .select(
            key,
            F.lit(True).alias("_hot"),
            "_from",
            (floor_div(F.col("_to") - F.col("_from"), chunks) + 1).alias("_step"),
        )
    )
    place = floor_div(F.col(order) - F.col("_from"), F.col("_step"))
    chunk = F.when(F.col("_hot"), place).otherwise(F.lit(0)).cast("bigint")
    rows = df.join(F.broadcast(hot), key, "left").withColumn("_chunk", chunk).drop("_from", "_step")

    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(*before)
    lagged = rows.withColumn(name, F.last(value, ignorenulls=True).over(inside))

    across = Window.partitionBy(key).orderBy("_chunk").rowsBetween(*before)
    edges = (
        rows.filter("_hot")
        .groupBy(key, "_chunk")
        .agg(F.max_by(value, F.when(fits, F.col(order))).alias("_last"))
        .withColumn("_edge", F.last("_last", ignorenulls=True).over(across))
        .select(key, "_chunk", "_edge")
    )
    return (
        lagged.join(edges, [key, "_chunk"], "left")
        .withColumn(name, F.coalesce(name, "_edge"))
        .drop("_edge", "_chunk", "_hot")
    )


def running(
    df: DataFrame, key: str, time: str, values: dict[str, tuple[Column, str]], width_seconds: int = 86_400
) -> DataFrame:
    """Add running totals of a key's rows by ``time``, this row included, a slice of time at a time.

    ``values`` names for each new column what it runs over and how: ``sum``, ``max`` or ``min``. A
    plain window sorts all rows of a key in one task. Here it sorts ``width_seconds`` of them; a slice
    folds to one row per value, those are summed up before it, and what they give is handed back. So of a
    key with most rows one task sees a row per slice. Nulls in ``key`` and ``time`` are values of their own.
    """
    fold = {"sum": F.sum, "max": F.max, "min": F.min}
    micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), F.col(time).cast("timestamp_ntz"))
    rows = df.withColumn("_slice", floor_div(micros, width_seconds * 1_000_000))
    edges = rows.groupBy(F.col(key).alias("_key"), F.col("_slice").alias("_at")).agg(
        *[fold[how](value).alias(f"_{name}") for name, (value, how) in values.items()]
    )
    before = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        "_key", "_at", *[fold[how](f"_{name}").over(before).alias(f"_{name}") for name, (_, how) in values.items()]
    )
    inside = Window.partitionBy(key, "_slice").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[fold[how](value).over(inside).alias(name) for name, (value, how) in values.items()])
    both = local.join(edges, local[key].eqNullSafe(edges["_key"]) & local["_slice"].eqNullSafe(edges["_at"]))

    def joined(name: str, how: str) -> Column:
        here, earlier = F.col(name), F.col(f"_{name}")
        if how == "sum":
            return F.coalesce(here + earlier, here, earlier)
        return F.greatest(here, earlier) if how == "max" else F.least(here, earlier)

    others = [c for c in df.columns if c not in values]
    return both.select(*others, *[joined(name, how).alias(name) for name, (_, how) in values.items()])
