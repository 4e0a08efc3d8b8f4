from __future__ import annotations

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from changeflow.operators import reconcile as R
from changeflow.plans import queries as Q
from changeflow.schemas import CURRENT

AT = datetime(2026, 1, 1, 0, 0, 1, 123000)


def table(spark, items):
    data = [(o, f"k{o}", e, 1, "created", cents, at, 1) for o, e, cents, at in items]
    return spark.createDataFrame(data, CURRENT)


def base(spark):
    return table(spark, [(1, 11, 100, AT), (2, 12, 200, AT), (3, 13, 300, AT)])


def sides(df):
    return rows(df, "side", "order_id", "amount_cents")


def test_equal_tables_have_no_diff(spark):
    b = base(spark)
    assert R.snapshot_diff(b, b).count() == 0
    assert R.snapshot_diff_all(b, b).count() == 0
    assert R.column_diff(b, b).count() == 0


def test_missing_ghost_and_changed_rows(spark):
    wrong = table(spark, [(1, 11, 100, AT), (2, 12, 201, AT), (9, 19, 900, AT)])
    assert sides(R.snapshot_diff(base(spark), wrong)) == [
        ("missing", 2, 200), ("missing", 3, 300), ("unexpected", 2, 201), ("unexpected", 9, 900),
    ]
    assert rows(R.column_diff(base(spark), wrong), "order_id", "kind", "first_column") == [
        (2, "changed", "amount_cents"), (3, "missing", None), (9, "unexpected", None),
    ]


def test_copies_show_only_in_the_multiset_diff(spark):
    twice = base(spark).unionByName(base(spark).filter("order_id = 2"))
    assert R.snapshot_diff(base(spark), twice).count() == 0
    assert rows(R.snapshot_diff_all(base(spark), twice), "side", "order_id", "copies") == [("unexpected", 2, 1)]
    assert rows(R.column_diff(base(spark), twice), "order_id", "kind", "target_copies") == [(2, "repeated", 2)]
    assert rows(R.repeated_keys(twice, ["order_id", "event_id"])) == [("event_id", "12", 2), ("order_id", "2", 2)]


def test_times_compare_to_the_millisecond(spark):
    finer = table(spark, [(1, 11, 100, AT.replace(microsecond=123999)), (2, 12, 200, AT), (3, 13, 300, AT)])
    assert R.snapshot_diff(base(spark), finer).count() == 0
    later = table(spark, [(1, 11, 100, AT.replace(microsecond=124000)), (2, 12, 200, AT), (3, 13, 300, AT)])
    assert R.snapshot_diff(base(spark), later).count() == 2


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "event_id bigint")


@pytest.mark.parametrize(
    "target, log, sets, log_set, log_rows",
    [
        ([1, 2], [1, 2, 2, 3], True, True, True),
        ([1], [1, 2, 2, 3], False, True, True),
        ([1, 2, 2], [1, 2, 2, 3], True, True, True),
        ([1, 2], [1, 2, 3], True, True, False),
        ([1, 2], [1, 2, 2, 4], True, False, True),
    ],
)
def test_event_id_audit(spark, target, log, sets, log_set, log_rows):
    audit = R.event_id_audit(
        ids(spark, [1, 2]), ids(spark, target), ids(spark, [1, 2]), ids(spark, log), ids(spark, [1, 2, 2, 3])
    ).first()
    assert (audit["current_sets_match"], audit["changelog_set_match"], audit["changelog_row_count_match"]) == (
        sets, log_set, log_rows,
    )
    assert audit["consistent"] == (sets and log_set and log_rows)


def test_empty_tables_still_compare_expected_ids(spark):
    none = ids(spark, [])
    assert R.event_id_audit(none, none, none, none, none).first()["consistent"]
    audit = R.event_id_audit(none, none, ids(spark, [1]), none, ids(spark, [1])).first()
    assert not audit["consistent"] and not audit["current_sets_match"]


def test_summary_is_right_and_a_damaged_table_fails(spark):
    b = base(spark)
    good = R.reconcile_summary(b, b, b, b, b).first()
    assert good["reconciled"] and good["source_row_count"] == 3 and good["snapshot_diff_count"] == 0
    bad = R.reconcile_summary(b, b.filter("order_id > 1"), b, b, b).first()
    assert not bad["reconciled"] and bad["missing_count"] == 1 and bad["target_row_count"] == 2


def test_commit_lag(spark):
    lag = R.commit_lag(ids(spark, [1, 2, 5]), ids(spark, [1])).first()
    assert lag.asDict() == {
        "source_max_event_id": 5, "table_max_event_id": 1, "max_event_id_gap": 4,
        "source_rows": 3, "changelog_rows": 1, "lag_events": 2,
    }
    ahead = R.commit_lag(ids(spark, []), ids(spark, [1, 2])).first()
    assert (ahead["max_event_id_gap"], ahead["lag_events"], ahead["source_max_event_id"]) == (0, 0, 0)
    seqs = lambda v: spark.createDataFrame([(x,) for x in v], "_seq bigint")
    assert R.position_lag(seqs([1, 9]), seqs([1, 4])).first()["position_lag"] == 5
    assert R.position_lag(seqs([]), seqs([])).first()["position_lag"] == 0
    places = lambda v: spark.createDataFrame(v, "_file bigint, _seq bigint")
    lag = R.position_lag(places([(7, 4), (6, 900)]), places([(5, 10**10)])).first()
    assert (lag["position_lag"], lag["file_lag"]) == (4, 2)


def test_scenario_summary_needs_a_scenario(spark):
    schema = "kind string, snapshot_diff_count bigint, consistent boolean, error string"
    flags = ("passed", "all_snapshot_diffs_zero", "all_event_id_audits_consistent")
    roll = lambda data: tuple(R.scenario_summary(spark.createDataFrame(data, schema)).first()[f] for f in flags)
    assert roll([]) == (False, False, False)
    assert roll([("a", 0, True, None)]) == (True, True, True)
    assert roll([("a", 0, True, None), ("b", 2, False, None)]) == (True, False, False)
    assert roll([("a", 0, True, "timed out")]) == (False, False, False)


def test_status_map(spark):
    b = base(spark)
    assert R.same_statuses(b, b).first()["matches"]
    other = b.withColumn("status", F.when(F.col("order_id") == 1, "paid").otherwise(F.col("status")))
    assert R.same_statuses(b, other).first()["diff_count"] == 2


def test_the_damaged_table_is_caught(spark, sf):
    clean = Q.orders_current(spark, sf)
    wrong = Q.damage(clean)
    assert R.snapshot_diff(clean, wrong).count() > 0
    assert R.progress(clean).first()["rows"] == 1343


def test_as_many_rows_with_other_contents_differ(spark):
    a, b = base(spark).filter("order_id = 1"), base(spark).filter("order_id = 1").selectExpr(
        *[c if c != "amount_cents" else "amount_cents + 1 AS amount_cents" for c in base(spark).columns]
    )
    diff = R.column_diff(a.unionByName(b), b.unionByName(b))
    assert rows(diff, "order_id", "kind", "first_column", "source_copies", "target_copies") == [
        (1, "changed", "amount_cents", 2, 2)
    ]
    assert R.column_diff(a.unionByName(b), b.unionByName(a)).count() == 0


def test_documents_that_differ_in_writing_alone_are_equal(spark):
    docs = lambda v: spark.createDataFrame([(x,) for x in v], "doc string")
    left = ['{"b": 1.50, "a": [1, {"y": null, "x": "\\u0041, \\"1.0"}]}', "[1e2, -0.0, 1e-3]", "broken {", "[1, 2]", '"12345678901234567890123e0"', None]
    right = ['{"a":[1.0,{"x":"A, \\"1.0","y":null}],"b":15e-1}', "[100,0,0.001]", "broken {", "[2, 1]", '"12345678901234567890123e0"', None]
    assert rows(R.canonical_diff(docs(left), docs(right), "doc")) == [("missing", "[1,2]"), ("unexpected", "[2,1]")]
