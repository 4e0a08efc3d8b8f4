"""File layout: metrics, planning time, before-and-after checks."""

from __future__ import annotations

import statistics
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeflow.functions import scalars as S

#: metric, and whether a good rewrite makes it smaller
LAYOUT_CHECKS = {
    "data_file_count": "decreased",
    "commit_count": "decreased",
    "median_file_size_bytes": "increased",
    "planning_latency_ms": "decreased",
}


def data_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Path and size of every data file under ``path``; only the listing is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "length")
    )


#: Slices per doubling of a value when looking for the middle: each is 0.07 percent wide.
SLICES_PER_OCTAVE = 1024


def distribution(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, sum, smallest, largest and exact median of a whole-number column per group, in one scan.

    Nulls count nothing; a group of nulls only, and no rows at all without ``by``, give zero values
    and null statistics. The built-in median keeps every distinct value of a group in one task. Here
    values fold to counts, counts to slices, and only the slice (or two) in which the middle lies is
    looked into. All other figures follow from the slices.
    """
    names = [*by, "_all"]
    v, n = F.col("_v"), F.col("_n")
    slice_of = F.signum(v) * F.floor(F.log2(F.abs(v.cast("double")) + 1) * SLICES_PER_OCTAVE)
    counts = (
        df.select(*by, F.lit(0).alias("_all"), F.col(value).cast("bigint").alias("_v"))
        .groupBy(*names, "_v")
        .agg(F.count("_v").alias("_n"))
        .withColumn("_slice", F.coalesce(slice_of.cast("bigint"), F.lit(0).cast("bigint")))
    )
    whole = Window.partitionBy(*names)
    up_to = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_total")
    slices = (
        counts.groupBy(*names, "_slice")
        .agg(
            F.sum("_n").alias("_n"),
            F.sum(v * n).alias("_s"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
        )
        .withColumn("_end", F.sum("_n").over(up_to))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_s", F.sum("_s").over(whole))
        .withColumn("_min", F.min("_min").over(whole))
        .withColumn("_max", F.max("_max").over(whole))
        .withColumn("_start", F.col("_end") - n)
        .withColumn("_low", S.floor_div(total + 1, 2))
        .withColumn("_high", S.floor_div(total, 2) + 1)
    )
    holds = lambda rank: (F.col("_start") < F.col(rank)) & (F.col(rank) <= F.col("_end"))
    middle = slices.filter(holds("_low") | holds("_high") | (total == 0)).drop("_n", "_end")
    # Null-safe: null is a group of its own, and neither side gets a filter the other lacks, so
    # both read the counts of one shuffle.
    same = F.lit(True)
    for c in [*names, "_slice"]:
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"m.{c}"))
    looked = counts.alias("c").join(middle.alias("m"), same).select(
        *[F.col(f"c.{c}").alias(c) for c in [*names, "_slice"]],
        "_v", "_n", "_start", "_low", "_high", "_total", "_s", "_min", "_max",
    )
    within = (
        Window.partitionBy(*names, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = looked.withColumn("_end", F.col("_start") + F.sum("_n").over(within)).withColumn(
        "_start", F.col("_end") - n
    )
    grouped = ranked.groupBy(*by).agg(
        F.coalesce(F.max("_total"), F.lit(0)).cast("bigint").alias("count"),
        F.max("_s").alias("total"),
        F.max("_min").alias("smallest"),
        F.max("_max").alias("largest"),
        F.max(F.when(holds("_low"), v)).alias("_a"),
        F.max(F.when(holds("_high"), v)).alias("_b"),
    )
    median = (F.col("_a").cast("double") + F.col("_b")) / 2.0
    return grouped.withColumn("median", median).drop("_a", "_b")


def exact_median(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact median of a whole-number column, one row per group that holds a value."""
    return distribution(df, value, by).filter("count > 0").select(*by, "median")


def size_stats(files: DataFrame, size: str = "length", by: tuple[str, ...] = ()) -> DataFrame:
    """Count, total, exact median, smallest and largest file; all zero where there is none."""
    zero = F.lit(0).cast("bigint")
    return distribution(files, size, by).select(
        *by,
        F.col("count").cast("int").alias("data_file_count"),
        F.coalesce("total", zero).alias("total_data_file_size_bytes"),
        F.coalesce("smallest", zero).alias("min_file_size_bytes"),
        F.coalesce("largest", zero).alias("max_file_size_bytes"),
        F.coalesce("median", F.lit(0.0)).alias("median_file_size_bytes"),
    )


def planned_scan_tasks(df: DataFrame) -> int:
    """Tasks the scan of ``df`` would start."""
    return df.rdd.getNumPartitions()


def planning_latency_ms(open_table, repetitions: int = 7) -> float:
    """Median time to list and plan a fresh scan, in milliseconds with three decimals."""
    if repetitions < 1:
        raise ValueError("repetitions must be positive")
    times = []
    for _ in range(repetitions):
        start = time.perf_counter_ns()
        open_table()._jdf.queryExecution().executedPlan()
        times.append(time.perf_counter_ns() - start)
    return round(statistics.median(times) / 1e6, 3)


def file_layout(table, repetitions: int = 7) -> DataFrame:
    """One row: files a reader opens, their sizes, commits it consults, planning time and tasks.

    ``table`` is a change table. Planning time is reported, never judged here.
    """
    snapshot = table.latest_snapshot()
    stats = size_stats(table.live_files(snapshot))
    commits = table.live_commits(snapshot).agg(F.count(F.lit(1)).cast("int").alias("n")).first()["n"]
    opened = table.open_files(snapshot)
    return stats.select(
        "*",
        F.lit(commits + (snapshot is not None)).alias("commit_count"),
        F.lit(planning_latency_ms(lambda: table.open_files(snapshot), repetitions)).alias(
            "planning_latency_ms"
        ),
        F.lit(repetitions).alias("planning_repetitions"),
        F.lit(planned_scan_tasks(opened)).alias("planned_file_scan_tasks"),
    )


def median_ms(timings: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Median of repeated nanosecond timings, in milliseconds with three decimals."""
    return exact_median(timings, column, by).select(
        *by, F.round(F.col("median") / 1e6, 3).alias("median_ms")
    )


def layout_deltas(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """After minus before for every metric, and the strict directional checks.

    One row per ``key`` on each side; the sides are tagged and grouped, not joined.
    """
    names = list(LAYOUT_CHECKS)
    tag = lambda df, side: df.select(key, *[F.col(n).cast("double").alias(n) for n in names], F.lit(side).alias("_side"))
    both = tag(before, "b").unionByName(tag(after, "a")).groupBy(key)
    at = lambda n, side: F.max(F.when(F.col("_side") == side, F.col(n)))
    rows = both.agg(
        *[at(n, "b").alias(f"{n}_before") for n in names], *[at(n, "a").alias(f"{n}_after") for n in names]
    )
    out = [F.col(key)]
    for name, direction in LAYOUT_CHECKS.items():
        b, a = F.col(f"{name}_before"), F.col(f"{name}_after")
        better = a < b if direction == "decreased" else a > b
        out += [(a - b).alias(f"{name}_delta"), F.coalesce(better, F.lit(False)).alias(f"{name}_{direction}")]
    return rows.select(*out)
