"""Shapes of physical plans: what is pushed down, what is folded before a shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from changeflow.operators import decode as D
from changeflow.operators import reconcile, runmetrics, state
from changeflow.plans import queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_used(spark, sf):
    text = plan(Q.QUERIES["size_stats"](spark, sf))
    assert "ReadSchema: struct<source:string,n_chars:bigint>" in text
    assert "props" not in plan(Q.decode_changes(spark, sf))
    lag = Q.QUERIES["commit_lag"](spark, sf)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string>" in plan(lag)


@pytest.mark.parametrize("name", ["current_state", "snapshot_diff", "uniqueness", "metric_max", "scenario_final"])
def test_groups_are_folded_before_every_shuffle(spark, sf, name):
    lines = plan(Q.QUERIES[name](spark, sf)).splitlines()
    shuffles = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line]
    assert shuffles
    for i in shuffles:
        assert "Aggregate(" in lines[i + 1] and "partial" in lines[i + 1]


def test_no_query_pairs_rows_without_a_key(spark, sf):
    for name in ("snapshot_diff", "column_diff", "merge_on_read", "interval_max", "sql_asof", "event_id_audit"):
        text = plan(Q.QUERIES[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_a_hot_key_sends_one_row_per_task(spark):
    # a third of all rows share one key
    rows = spark.range(0, 30_000, 1, 6).selectExpr("IF(id % 3 = 0, -1L, id) AS order_id", "id AS _seq")
    changes = rows.selectExpr(
        "order_id", "concat('k', order_id) AS business_key", "_seq AS event_id", "1L AS customer_id",
        "'created' AS status", "_seq AS amount_cents", "TIMESTAMP_NTZ'2026-01-01' AS updated_at", "1 AS seed",
        "'+U' AS cdc_row_kind", "'update_after' AS cdc_operation", "0L AS source_ts_ms", "_seq", "1Y AS _img",
    )
    out = state.current_state(changes)
    assert out.count() == 20_001
    assert out.filter("order_id = -1").first()["event_id"] == 29_997
    diff = reconcile.snapshot_diff_all(changes.select(*out.columns), out)
    assert diff.agg(F.sum("copies")).first()[0] == 9_999
    data, deletes = state.upsert_files(changes)
    for salt in (1, 4):
        live = state.apply_equality_deletes(data, deletes, salt=salt)
        assert live.count() == 20_001


def test_a_hot_key_of_the_data_is_split_before_it_meets_its_delete(spark, tmp_path):
    changes = spark.range(200_000).selectExpr(
        "IF(id % 2 = 0, -1L, id) AS order_id", "id AS _seq", "repeat(md5(string(id)), 4) AS business_key", "'+U' AS cdc_row_kind"
    )
    changes.write.parquet(str(tmp_path / "changes"))
    changes = spark.read.parquet(str(tmp_path / "changes"))
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    kept = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        data, deletes = state.upsert_files(changes)
        live = state.apply_equality_deletes(data, deletes)
        assert len(live.collect()) == 100_001
        assert "skew=true" in plan(live)
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_decode_is_one_narrow_stage(spark, sf):
    text = plan(D.decode_upserts(Q.orders_feed(spark, sf)))
    assert "Exchange" not in text and "Python" not in text


def test_checkpoint_lists_need_no_shuffle(spark, sf):
    docs = Q._payloads(spark, sf)
    assert "Exchange" not in plan(runmetrics.completed_checkpoints(docs, "doc", ["event_id"]))
