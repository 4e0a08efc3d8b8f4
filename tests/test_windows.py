from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from changeflow.functions.windows import previous_row


def brute(data, want):
    out, last = {}, {}
    for key, order, kind in sorted(data, key=lambda r: (r[0], r[1])):
        out[order] = last.get(key)
        if want is None or kind == want:
            last[key] = order
    return out


@pytest.mark.parametrize("want", [None, "a", "never"])
@pytest.mark.parametrize("hot_rows, width", [(1 << 20, None), (5, 3), (20, 7), (1, 1)])
@pytest.mark.parametrize("stride", [1, 1 << 44])
def test_same_as_one_pass_over_each_key(spark, hot_rows, width, want, stride):
    rng = random.Random(3)
    # one key holds more than a third of the rows
    data = [
        ("hot" if rng.random() < 0.4 else f"k{rng.randrange(9)}", i * stride, rng.choice("ab"))
        for i in rng.sample(range(500), 200)
    ]
    df = spark.createDataFrame(data, "key string, ord bigint, kind string").repartition(3)
    where = None if want is None else F.col("kind") == want
    got = previous_row(df, "key", "ord", ["ord"], "prev", where, hot_rows, width)
    assert got.columns == ["key", "ord", "kind", "prev"]
    seen = {r["ord"]: r["prev"] and r["prev"]["ord"] for r in got.collect()}
    assert seen == brute(data, want)
