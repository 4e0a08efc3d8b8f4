from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from changeflow.operators import decode as D
from changeflow.operators import state
from changeflow.plans import queries as Q
from changeflow.schemas import CHANGE, CHANGE_COLUMNS, CURRENT_COLUMNS


def changes(spark, items):
    """(order_id, kind, seq, img, event_id) to change rows."""
    names = {"+I": "insert", "-U": "update_before", "+U": "update_after", "-D": "delete"}
    data = [
        (o, f"k{o}", e, 1, "created", e * 10, None, 1, kind, names[kind], None, 0, seq, 0, img)
        for o, kind, seq, img, e in items
    ]
    return spark.createDataFrame(data, CHANGE)


LIFE = [
    (1, "+I", 1, 1, 10),
    (1, "-U", 2, 0, 10),
    (1, "+U", 2, 1, 11),
    (2, "+I", 3, 1, 20),
    (2, "-D", 4, 0, 20),
    (3, "+I", 5, 1, 30),
    (3, "-D", 6, 0, 30),
    (3, "+I", 7, 1, 31),
]


def test_newest_change_wins_and_deletes_remove(spark):
    df = changes(spark, LIFE)
    assert rows(state.current_state(df), "order_id", "event_id") == [(1, 11), (3, 31)]
    kept = state.latest_by_key(df, keep_deletes=True)
    assert kept.columns == CHANGE_COLUMNS
    assert rows(kept, "order_id", "cdc_row_kind") == [(1, "+U"), (2, "-D"), (3, "+I")]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_arrival_order_and_partitions_do_not_matter(spark, sf, parts):
    feed = Q.events_feed(spark, sf)
    expected = rows(state.current_state(D.decode_upserts(feed)))
    shuffled = feed.repartition(parts, F.xxhash64("source.pos", F.lit(parts)))
    assert rows(state.current_state(D.decode_upserts(shuffled))) == expected
    assert rows(state.current_state(D.decode(shuffled))) == expected


@pytest.mark.parametrize("salt", [1, 5])
def test_equality_deletes(spark, salt):
    df = changes(spark, LIFE)
    data, deletes = state.upsert_files(df)
    live = state.apply_equality_deletes(data, deletes, salt=salt)
    assert rows(live, "order_id", "event_id") == [(1, 11), (3, 31)]
    # a delete does not reach rows written at its own position or later
    none = state.apply_equality_deletes(data, deletes.filter("_seq < 2"), salt=salt)
    assert none.count() == data.count()


def test_as_of_reads_only_older_batches(spark):
    df = changes(spark, LIFE).withColumn("batch_id", F.floor((F.col("_seq") - 1) / 3))
    assert rows(state.as_of(df, 0), "order_id", "event_id") == [(1, 11), (2, 20)]
    assert rows(state.as_of(df, 1), "order_id", "event_id") == [(1, 11)]
    assert rows(state.as_of(df, 2), "order_id", "event_id") == [(1, 11), (3, 31)]


@pytest.mark.parametrize("tail_rows", [None, 3, 10**9])
def test_snapshot_and_tail(spark, tail_rows):
    early = changes(spark, LIFE[:5])
    snapshot = state.latest_by_key(early, keep_deletes=True)
    # the tail also brings an old change of a deleted key, which must not bring it back
    tail = changes(spark, [*LIFE[5:], (2, "+U", 3, 1, 99), (1, "+U", 0, 1, 98)])
    both = state.live_rows(state.snapshot_plus_tail(snapshot, tail, tail_rows))
    assert both.columns == CURRENT_COLUMNS
    assert rows(both, "order_id", "event_id") == [(1, 11), (3, 31)]


def test_a_small_tail_does_not_shuffle_the_snapshot(spark, tmp_path):
    snapshot = state.latest_by_key(changes(spark, LIFE), keep_deletes=True)
    snapshot.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    plan = state.snapshot_plus_tail(stored, changes(spark, LIFE[:1]), 1)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in text and "LeftSemi" in text
    physical = plan._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in physical and physical.count("BroadcastHashJoin") == 2
