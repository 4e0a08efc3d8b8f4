from __future__ import annotations

import json

import pytest

from changeflow import __main__ as cli
from changeflow.operators import reconcile
from changeflow.plans.sqlapi import FAILURE_CLASSES
from changeflow.streaming import verify


def test_every_failure_class_ends_reconciled(spark, tmp_path):
    runs = spark.range(3).withColumnRenamed("id", "scenario_id")
    results = verify.verify_failures(spark, list(FAILURE_CLASSES), runs, str(tmp_path))
    rows = {r["failure_class"]: r for r in results.collect()}
    assert set(rows) == set(FAILURE_CLASSES)
    for r in rows.values():
        assert (r["snapshot_diff_count"], r["multiset_diff_count"], r["changelog_row_count"]) == (0, 0, 27)
        assert r["consistent"] and r["error"] is None
    assert rows["task-crash"]["restarts"] == rows["sink-commit-fault"]["restarts"] == 1
    summary = reconcile.scenario_summary(results).first()
    assert summary["passed"] and summary["all_snapshot_diffs_zero"] and summary["all_event_id_audits_consistent"]
    with pytest.raises(ValueError):
        verify.verify_failure(spark, "flood", runs, str(tmp_path))


@pytest.mark.parametrize("way", list(verify.RESTORE.values()))
def test_restores_interrupt_a_running_query(spark, tmp_path, sf, way, monkeypatch):
    from changeflow.plans import queries as Q
    from changeflow.streaming import ingest

    left = []
    stop_after = ingest.await_commits

    def watched(query, table, *rest, **more):
        stop_after(query, table, *rest, **more)
        left.append((query.isActive, table.commits().count()))

    monkeypatch.setattr(ingest, "await_commits", watched)
    feed = Q.orders_feed(spark, sf)
    table = verify.interrupted_ingest(spark, feed, str(tmp_path / "t"), way, files=8)
    active, commits = left[0]
    assert active and commits < 8
    assert table.commits().count() == 8
    assert (table.spark is not spark) == (way == "session")
    assert table.changelog().count() == Q.QUERIES["changelog_rows"](spark, sf).count()
    with pytest.raises(ValueError):
        verify.interrupted_ingest(spark, feed, str(tmp_path / "u"), "tape")


def test_small_files_are_merged(spark, tmp_path):
    profile = verify.RewriteProfile(batches=6, rows_per_batch=10)
    r = verify.rewrite_small_files(spark, profile, str(tmp_path / "t")).first()
    assert r["files_before"] >= 6 and r["files_after"] == 1
    assert r["data_file_count_decreased"] and r["commit_count_decreased"] and r["median_file_size_bytes_increased"]
    assert r["commit_count_delta"] == -5


def test_a_spike_drains(spark, tmp_path):
    profile = verify.LoadProfile(spike_events=60, files=4, poll_seconds=0.2)
    samples, summary = verify.run_under_load(spark, profile, str(tmp_path / "t"))
    s = summary.first()
    assert s["lag_observed"] and s["lag_recovered"] and s["failure_count_recorded"]
    assert s["load_max_lag_events"] <= 60 and s["final_lag_events"] == 0
    assert samples.filter("phase = 'baseline'").count() == 2


def test_command_line(spark, tmp_path, capsys):
    base, source = str(tmp_path / "t"), str(tmp_path / "source")
    assert cli.main(["generate", "--out", source, "--events", "30", "--seed", "5"]) == 0
    landing = str(tmp_path / "landing")
    from changeflow.sources import readers, statements

    statements.insert(readers.source_rows(spark, source), 1).write.json(landing)
    run = ["ingest", "--base", base, "--landing", landing, "--checkpoint", str(tmp_path / "c"), "--writer", "cli"]
    assert cli.main(run) == 0
    assert json.loads(capsys.readouterr().out)["total_rows"] == 30
    assert cli.main(["reconcile", "--base", base, "--source", source]) == 0
    assert cli.main(["compact", "--base", base]) == 0
    assert cli.main(["layout", "--base", base, "--repetitions", "2"]) == 0
    assert cli.main(["inspect", "--base", base]) == 0
    capsys.readouterr()
    assert cli.main(["sql", "--base", base, "--query", "SELECT count(*), max(order_id) FROM orders_current"]) == 0
    assert capsys.readouterr().out == "30\t30\n"
    with pytest.raises(ValueError, match="query is required"):
        cli.main(["sql", "--base", base])
    out = str(tmp_path / "evidence")
    assert cli.main(["verify", "--failure", "task-crash", "--out", out]) == 0
    assert spark.read.json(out).first()["passed"] is True
