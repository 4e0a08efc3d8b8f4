from __future__ import annotations

import random
import statistics

import pytest
from conftest import rows

from changeflow.operators import maintain as M

LAYOUT = "t string, data_file_count int, commit_count int, median_file_size_bytes double, planning_latency_ms double"


def stats(spark, sizes):
    return M.size_stats(spark.createDataFrame([(s,) for s in sizes], "length bigint")).first()


@pytest.mark.parametrize("sizes, median", [([], 0.0), ([5], 5.0), ([1, 9, 4], 4.0), ([1, 2, 10, 20], 6.0), ([3, 3, 3, 3], 3.0)])
def test_size_stats(spark, sizes, median):
    s = stats(spark, sizes)
    assert s["median_file_size_bytes"] == median
    assert s["data_file_count"] == len(sizes)
    assert s["total_data_file_size_bytes"] == sum(sizes)
    assert s["min_file_size_bytes"] == min(sizes, default=0)
    assert s["max_file_size_bytes"] == max(sizes, default=0)


def test_exact_median_against_sorting(spark):
    rng = random.Random(9)
    data = [(rng.choice("aaab"), rng.choice([rng.randrange(-50, 50), rng.randrange(10**12)])) for _ in range(401)]
    data += [("one", 7), ("two", -3), ("two", 4), ("none", None)]
    got = dict(rows(M.exact_median(spark.createDataFrame(data, "g string, v bigint"), "v", ("g",))))
    want = {
        g: float(statistics.median([v for h, v in data if h == g and v is not None]))
        for g in ("a", "b", "one", "two")
    }
    assert got == want


def test_median_timing(spark):
    df = spark.createDataFrame([(1_234_567,), (2_000_000,), (9_000_000,), (2_000_001,)], "ns bigint")
    assert M.median_ms(df, "ns").first()["median_ms"] == 2.0


def deltas(spark, before, after):
    frame = lambda row: spark.createDataFrame([("t", *row)], LAYOUT)
    return M.layout_deltas(frame(before), frame(after), "t").first()


def test_improvements_must_be_strict(spark):
    good = deltas(spark, (24, 24, 4096.0, 80.0), (2, 1, 49152.0, 12.5))
    assert good["data_file_count_decreased"] and good["commit_count_decreased"]
    assert good["median_file_size_bytes_increased"] and good["planning_latency_ms_decreased"]
    assert good["data_file_count_delta"] == -22 and good["planning_latency_ms_delta"] == -67.5
    slower = deltas(spark, (24, 24, 4096.0, 10.0), (2, 1, 49152.0, 12.5))
    assert not slower["planning_latency_ms_decreased"] and slower["data_file_count_decreased"]
    same = deltas(spark, (2, 1, 10.0, 5.0), (2, 1, 10.0, 5.0))
    assert not any(same[c] for c in same.asDict() if c.endswith(("decreased", "increased")))


def test_planning_needs_a_repetition(spark):
    with pytest.raises(ValueError):
        M.planning_latency_ms(lambda: spark.range(1), 0)


def test_null_groups_and_nulls(spark):
    data = [(None, 3), (None, 5), (None, None), ("a", None), ("b", 7), ("b", -2), ("b", -2)]
    df = spark.createDataFrame(data, "g string, length bigint")
    want = [("a", 0, 0, 0, 0, 0.0), ("b", 3, 3, -2, 7, -2.0), (None, 2, 8, 3, 5, 4.0)]
    names = ["data_file_count", "total_data_file_size_bytes", "min_file_size_bytes", "max_file_size_bytes"]
    got = rows(M.size_stats(df, by=("g",)), "g", *names, "median_file_size_bytes")
    assert got == sorted(want, key=str)
    assert rows(M.exact_median(df, "length", ("g",))) == sorted([(None, 4.0), ("b", -2.0)], key=str)
    assert M.exact_median(df.limit(0), "length").count() == 0


def test_sizes_are_scanned_once(spark, sf):
    from changeflow.plans import queries as Q

    out = Q.QUERIES["size_stats"](spark, sf)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1
