from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from changeflow.operators import decode as D
from changeflow.operators import maintain, state
from changeflow.plans import queries as Q
from changeflow.sources import feeds
from changeflow.streaming.ingest import FailOnce
from changeflow.streaming.table import ChangeTable, Hooks


@pytest.fixture
def table(spark, tmp_path):
    return ChangeTable(spark, str(tmp_path / "t")).create()


@pytest.fixture
def feed(spark, sf):
    return Q.events_feed(spark, sf).cache()


def day(feed, low, high):
    return feed.filter(F.col("ts_ms").between(low * 86_400_000, high * 86_400_000 - 1))


def expected_current(feed):
    return rows(state.current_state(D.decode_upserts(feed)))


def test_a_new_table_is_empty(table):
    assert table.changelog().count() == 0
    assert table.current().count() == 0
    assert table.latest_snapshot() is None
    summary = table.commit_summary().first()
    assert (summary["commit_count"], summary["total_rows"], summary["added_rows"]) == (0, 0, 0)
    assert table.create().commits().count() == 0  # creating again changes nothing


def test_batches_are_stored_once(table, feed):
    assert table.append_envelopes(feed, "w", 0)
    n = table.changelog().count()
    assert n == 1586
    assert not table.append_envelopes(feed, "w", 0)
    assert table.changelog().count() == n
    assert rows(table.current()) == expected_current(feed)
    commit = table.commits().first()
    assert (commit["rows"], commit["rejects"], commit["writer_id"], commit["block"]) == (n, 0, "w", 0)


@pytest.mark.parametrize("point", ["before_write", "before_commit"])
def test_a_failed_batch_is_invisible_and_replayed(spark, tmp_path, feed, point):
    table = ChangeTable(spark, str(tmp_path / "t"), hooks=Hooks(**{point: FailOnce(1)})).create()
    table.append_envelopes(day(feed, 0, 19730), "w", 0)
    seen = table.changelog().count()
    with pytest.raises(RuntimeError):
        table.append_envelopes(day(feed, 19730, 30000), "w", 1)
    assert table.changelog().count() == seen
    table.append_envelopes(day(feed, 19730, 30000), "w", 1)
    assert table.changelog().count() == 1586
    assert rows(table.current()) == expected_current(feed)


def test_a_batch_that_failed_after_its_commit_is_skipped(spark, tmp_path, feed):
    table = ChangeTable(spark, str(tmp_path / "t"), hooks=Hooks(after_commit=FailOnce(0))).create()
    with pytest.raises(RuntimeError):
        table.append_envelopes(feed, "w", 0)
    before = rows(table.files(table.path("changelog")), "path")
    assert not table.append_envelopes(feed, "w", 0)
    assert rows(table.files(table.path("changelog")), "path") == before
    assert table.changelog().count() == 1586


def test_another_writer_with_the_same_batch_number_is_no_replay(table, feed):
    table.append_envelopes(day(feed, 0, 19730), "first", 0)
    assert table.append_envelopes(day(feed, 19730, 30000), "second", 0)
    assert rows(table.current()) == expected_current(feed)


def test_writer_names_that_look_like_numbers_stay_text(table, feed):
    table.append_envelopes(feed, "007", 3)
    assert rows(table.commits(), "writer_id", "batch_id") == [("007", 3)]
    assert table.changelog().count() == 1586


def test_rejects_are_kept_and_counted(table, feed):
    lost = F.when(F.col("source.pos") % 10 != 0, F.col("after"))
    damaged = feed.withColumn("after", lost)
    bad = D.rejects(damaged).count()
    assert bad > 0
    table.append_envelopes(damaged, "w", 0)
    assert table.rejects().count() == bad
    assert table.commits().first()["rejects"] == bad
    assert table.changelog().count() == D.decode(damaged).count()


def test_fail_mode_commits_nothing(table, feed):
    damaged = feed.withColumn("op", F.lit("x"))
    with pytest.raises(Exception, match="unsupported operation"):
        table.append_envelopes(damaged, "w", 0, mode="fail")
    assert table.commits().count() == 0 and table.changelog().count() == 0


def test_older_versions_stay_readable(table, feed):
    for n in range(3):
        table.append_envelopes(day(feed, 19723 + 10 * n, 19733 + 10 * n), "w", n)
    for n in range(3):
        part = day(feed, 0, 19733 + 10 * n)
        assert rows(table.as_of(n)) == expected_current(part)
    plan = table.committed_changes(1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan


def test_compaction_keeps_the_state_and_shrinks_the_layout(spark, table, feed):
    for n in range(6):
        table.append_envelopes(day(feed, 19723 + 5 * n, 19728 + 5 * n).repartition(4), "w", n)
    want = rows(table.current())
    before = maintain.size_stats(table.live_files()).first()
    plan_before = maintain.planned_scan_tasks(table.stored())
    report = table.compact()
    after = maintain.size_stats(table.live_files(0)).first()
    assert rows(table.current()) == want == expected_current(feed)
    assert report["rewritten_files"] == before["data_file_count"] > after["data_file_count"] == report["added_files"]
    assert after["total_data_file_size_bytes"] < before["total_data_file_size_bytes"]
    assert plan_before >= 1
    assert maintain.planning_latency_ms(table.current, 3) > 0
    # nothing was removed: the audit and older versions are whole
    assert table.changelog().count() == 1586


def test_changes_committed_during_a_compaction_are_not_lost(table, feed, monkeypatch):
    table.append_envelopes(day(feed, 0, 19730), "w", 0)
    original = state.latest_by_key

    def and_meanwhile(*args, **kwargs):
        if not table.is_committed("w", 1):
            table.append_envelopes(day(feed, 19730, 19740), "w", 1)
        return original(*args, **kwargs)

    monkeypatch.setattr(state, "latest_by_key", and_meanwhile)
    table.compact()
    monkeypatch.undo()
    assert table.is_committed("w", 1)
    assert rows(table.current()) == expected_current(day(feed, 0, 19740))
    table.append_envelopes(day(feed, 19740, 30000), "w", 2)
    assert rows(table.current()) == expected_current(feed)


def test_a_tail_read_prunes_covered_batches(table, feed):
    table.append_envelopes(day(feed, 0, 19730), "w", 0)
    table.compact()
    table.append_envelopes(day(feed, 19730, 30000), "w", 1)
    tail = table._changes_of(table.live_commits(0))
    plan = tail._jdf.queryExecution().sparkPlan().toString()
    assert "batch_id" in plan.split("PartitionFilters: [")[1].split("]")[0] and ">= 1" in plan
    assert tail.count() == 1586 - table.committed_changes(0).count()


def test_compaction_on_top_of_a_snapshot(table, feed):
    table.append_envelopes(day(feed, 0, 19730), "w", 0)
    assert table.compact()["snapshot_id"] == 0
    table.append_envelopes(day(feed, 19730, 30000), "w", 1)
    assert rows(table.current()) == expected_current(feed)
    assert table.compact()["snapshot_id"] == 1
    assert rows(table.current()) == expected_current(feed)


def test_a_late_change_does_not_bring_a_deleted_key_back(table, feed):
    table.append_envelopes(feed.filter("op = 'd'"), "w", 0)
    table.compact()
    table.append_envelopes(feed.filter("op <> 'd'"), "w", 1)
    assert rows(table.current()) == expected_current(feed)


def test_an_unfinished_snapshot_is_ignored(table, feed):
    table.append_envelopes(feed, "w", 0)
    table.compact()
    feed.limit(1).select("op").write.parquet(table.path("snapshots", "id=1", "rows"))
    assert table.latest_snapshot() == 0
    assert rows(table.current()) == expected_current(feed)


def test_file_sizes_can_be_tuned(spark, tmp_path, feed):
    table = ChangeTable(spark, str(tmp_path / "t"), max_records_per_file=100).create()
    table.append_envelopes(feed.coalesce(1), "w", 0)
    assert table.files(table.path("changelog")).count() >= 1586 // 100
    loaded = str(tmp_path / "bulk")
    feeds.write_orders(feeds.seeded_orders(spark, 250, 1).coalesce(1), loaded, rows_per_file=100)
    assert maintain.data_files(spark, loaded).count() == 3


def test_file_layout(table, feed):
    for n in range(4):
        table.append_envelopes(day(feed, 19723 + 8 * n, 19731 + 8 * n), "w", n)
    before = maintain.file_layout(table, 3).first()
    table.compact()
    after = maintain.file_layout(table, 3).first()
    assert (before["commit_count"], after["commit_count"]) == (4, 1)
    assert before["data_file_count"] > after["data_file_count"] >= 1
    assert before["planning_latency_ms"] > 0 and before["planning_repetitions"] == 3
    assert before["planned_file_scan_tasks"] >= after["planned_file_scan_tasks"] >= 1


def test_listing_reads_no_contents(spark, sf):
    files = maintain.data_files(spark, sf)
    assert files.count() == 14
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_commit_folders_are_split_into_blocks(table, feed):
    table.append_envelopes(feed.limit(5), "w", 2500)
    assert table.exists(table.path("commits", "writer_id=w", "block=2", "2500.json"))


def test_a_batch_committed_late_under_a_lower_id_is_seen(table, feed):
    table.append_envelopes(day(feed, 19730, 30000), "w", 5)
    table.compact()
    table.append_envelopes(day(feed, 0, 19730), "w", 3)
    assert rows(table.current()) == expected_current(feed)
    table.compact()
    assert rows(table.current()) == expected_current(feed)


def test_versions_of_two_writers(table, feed):
    table.append_envelopes(day(feed, 0, 19730), "old", 900)
    table.append_envelopes(day(feed, 19730, 30000), "new", 0)
    with pytest.raises(ValueError, match="several writers"):
        table.as_of(0)
    assert rows(table.as_of(0, "new")) == expected_current(feed)
    assert rows(table.as_of(900, "old")) == expected_current(day(feed, 0, 19730))


def test_compaction_keeps_to_its_target(table, feed):
    table.append_envelopes(feed, "w", 0)
    size = table.live_files().agg({"length": "sum"}).first()[0]
    wanted = 9
    done = table.compact(-(-size // wanted))
    assert wanted / 2 <= done["added_files"] <= wanted * 2
