from __future__ import annotations

from pyspark.sql import functions as F

from changeflow.plans import queries


def test_an_expected_id_is_one_row_with_its_counts(spark, sf):
    wanted = queries._scenario_ids(spark, sf)
    ids = wanted.groupBy("scenario_id", "event_id").agg(F.count(F.lit(1)).alias("n"))
    assert ids.filter("n > 1").isEmpty()
    sums = wanted.groupBy("kind").agg(
        (F.sum("expected") / F.count_distinct("scenario_id")).alias("a"), (F.sum("expected_log") / F.count_distinct("scenario_id")).alias("b")
    )
    found = {r["kind"]: (int(r["a"]), int(r["b"])) for r in sums.collect()}
    assert found == {k: (len(queries.FINAL_IDS[k]), len(queries.LOG_IDS[k])) for k in queries.FINAL_IDS}
