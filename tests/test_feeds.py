from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from changeflow.operators import decode as D
from changeflow.operators import state
from changeflow.plans import queries as Q
from changeflow.sources import feeds

ANCHORS = {
    "orders": {"c": 1500, "u": 1479, "d": 157, "log": 4615, "live": 1343},
    "events": {"c": 170, "u": 629, "d": 158, "log": 1586, "live": 12},
}


@pytest.mark.parametrize("name", ["orders", "events"])
def test_feeds_have_the_known_size(spark, sf, name):
    feed = {"orders": Q.orders_feed, "events": Q.events_feed}[name](spark, sf).cache()
    want = ANCHORS[name]
    assert dict(rows(feed.groupBy("op").count())) == {k: want[k] for k in "cud"}
    assert D.decode(feed).count() == want["log"]
    assert state.current_state(D.decode_upserts(feed)).count() == want["live"]
    assert D.rejects(feed).count() == 0
    assert state.position_conflicts(D.decode(feed)).count() == 0


def test_hot_users_are_cut_into_ranges_without_changing_the_feed(spark, sf):
    whole = feeds.events_feed(feeds.table(spark, sf, "events"))
    cut = feeds.events_feed(feeds.table(spark, sf, "events"), hot_rows=20)
    assert rows(cut) == rows(whole)


def test_seeded_orders_repeat(spark):
    first, second = feeds.seeded_orders(spark, 100, 7), feeds.seeded_orders(spark, 100, 7).repartition(3)
    assert rows(first) == rows(second)
    assert rows(first, "event_id") == sorted([(i,) for i in range(1, 101)], key=str)
    assert first.select("business_key").distinct().count() == 100
    assert rows(first) != rows(feeds.seeded_orders(spark, 100, 8))
    assert first.filter("status not in ('created','paid','packed','shipped','delivered')").count() == 0
    assert first.filter("amount_cents not between 100 and 250099 or customer_id not between 1 and 100").count() == 0
    with pytest.raises(ValueError):
        feeds.seeded_orders(spark, 0, 1)


def test_sequence_orders(spark):
    rows_ = feeds.sequence_orders(
        spark.range(1, 4), "id", base_event_id=100, prefix="p-", customer_base=10, amount_base=7, seed=3
    ).orderBy("order_id").collect()
    assert [r["order_id"] for r in rows_] == [101, 102, 103]
    assert [r["status"] for r in rows_] == ["paid", "packed", "shipped"]
    assert rows_[0]["business_key"] == "p-000000000101"
    assert rows_[0]["amount_cents"] == 8 and rows_[0]["customer_id"] == 11
    assert str(rows_[0]["updated_at"]) == "2026-01-01 00:00:01"


def test_a_snapshot_precedes_the_log(spark, sf):
    feed = Q.orders_feed(spark, sf)
    first = feeds.snapshot_feed(feed.filter("op = 'c'").select("after.*"))
    changes = D.decode(first)
    assert rows(changes.select("cdc_row_kind", "cdc_operation").distinct()) == [("+I", "snapshot")]
    assert changes.agg(F.max("_seq")).first()[0] == -1


def test_the_feed_needs_no_shuffle(spark, sf):
    plan = D.decode(Q.orders_feed(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
