"""Numbered versions of a change log."""

from __future__ import annotations

import pytest
from conftest import rows

from changeflow.operators import decode as D
from changeflow.operators import state, versions
from changeflow.plans import queries as Q


def test_versions_of_two_writers(spark, tmp_path, sf):
    path = str(tmp_path / "log")
    log = D.decode(Q.orders_feed(spark, sf)).cache()
    early, late = log.filter("_seq % 4 = 0"), log.filter("_seq % 4 <> 0")
    # The second writer's clock and batch numbers say nothing: the number it gets does.
    assert [versions.commit(late, path), versions.commit(early, path)] == [1, 2]
    assert rows(versions.as_of(spark, path, 2)) == rows(state.current_state(log))
    assert rows(versions.as_of(spark, path, 1)) == rows(state.current_state(late))
    text = versions.changes_upto(spark, path, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(version" in text
    # A writer that has claimed a number but not put its rows in place.
    (tmp_path / "log" / "_claims" / "3").touch()
    assert versions.commit(early.limit(0), path) == 4
    assert versions.as_of(spark, path, 2).count() == state.current_state(log).count()
    with pytest.raises(ValueError, match="3"):
        versions.as_of(spark, path, 4)
