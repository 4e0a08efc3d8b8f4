from __future__ import annotations

import os
import shutil
import signal
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import rows
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from changeflow.operators import decode as D
from changeflow.operators import reconcile, state
from changeflow.plans import queries as Q
from changeflow.schemas import CURRENT_COLUMNS
from changeflow.sources import feeds
from changeflow.streaming import ingest
from changeflow.streaming.table import ChangeTable, Hooks

FINAL = {"smoke": [1002], "crash": [3, 4, 1002], "restore": [3, 4, 1002]}
CHANGELOG = {"smoke": 7, "crash": 9, "restore": 9}
DISTINCT = {"smoke": 4, "crash": 6, "restore": 6}


def script(spark, kind):
    """One scripted run with ids 1 to 4, split into one file per statement."""
    runs = spark.createDataFrame([(0, kind)], "scenario_id bigint, kind string")
    return feeds.scenario_feed(runs).orderBy("source.pos")


def land(feed, path, first, last):
    part = feed.filter(F.col("source.pos").between(first, last))
    part.coalesce(1).write.mode("append").json(path)


class Run:
    def __init__(self, spark, tmp_path, kind, hooks=None):
        self.spark, self.feed, self.kind = spark, script(spark, kind), kind
        self.landing, self.checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
        self.table = ChangeTable(spark, str(tmp_path / "table"), hooks=hooks or Hooks()).create()

    def start(self, checkpoint=None, spark=None):
        session = spark or self.spark
        stream = ingest.json_envelope_stream(session, self.landing, max_files=1)
        return ingest.start_ingest(stream, self.table, checkpoint or self.checkpoint, "w", name=f"t-{id(self)}")

    def verify(self):
        """Snapshot diff and id audit against the script itself."""
        truth = state.current_state(D.decode_upserts(self.feed))
        current, log = self.table.current(), self.table.changelog()
        expected = self.spark.createDataFrame([(i,) for i in FINAL[self.kind]], "event_id bigint")
        wanted_log = D.decode(self.feed).select("event_id")
        summary = reconcile.reconcile_summary(truth, current, expected, log, wanted_log).first()
        assert summary["reconciled"], summary
        assert summary["changelog_row_count"] == CHANGELOG[self.kind]
        assert summary["changelog_distinct_ids"] == DISTINCT[self.kind]
        assert reconcile.snapshot_diff_all(truth, current).count() == 0


@pytest.mark.parametrize("kind", ["smoke", "crash", "restore"])
def test_scripts_end_as_written(spark, tmp_path, kind):
    run = Run(spark, tmp_path, kind)
    land(run.feed, run.landing, 0, 3)
    ingest.drain(run.start())
    land(run.feed, run.landing, 4, 9)
    ingest.drain(run.start())
    run.verify()
    assert run.table.commits().count() == 2


@pytest.mark.parametrize("point", ["before_write", "before_commit", "after_commit"])
def test_a_batch_that_fails_once_is_recovered_by_restart(spark, tmp_path, point):
    fault = ingest.FailOnce(1)
    run = Run(spark, tmp_path, "crash", Hooks(**{point: fault}))
    for n in range(0, 7):
        land(run.feed, run.landing, n, n)
    assert ingest.run_with_restarts(run.start, delay=0.1) == 1
    assert fault.fired
    run.verify()


def test_restarts_are_used_up(spark, tmp_path):
    run = Run(spark, tmp_path, "crash")
    land(run.feed, run.landing, 0, 6)

    def always(batch_id):
        raise RuntimeError("always")

    run.table.hooks.before_write = always
    with pytest.raises(StreamingQueryException, match="always"):
        ingest.run_with_restarts(run.start, attempts=2, delay=0.1)
    run.table.hooks.before_write = lambda batch_id: None
    assert ingest.run_with_restarts(run.start) == 0
    run.verify()


@pytest.mark.parametrize("how", ["same checkpoint", "copied checkpoint", "new session"])
def test_restore(spark, tmp_path, how):
    run = Run(spark, tmp_path, "restore")
    land(run.feed, run.landing, 0, 2)
    ingest.drain(run.start())
    land(run.feed, run.landing, 3, 9)
    if how == "copied checkpoint":
        copy = str(tmp_path / "copy")
        shutil.copytree(run.checkpoint, copy)
        ingest.drain(run.start(checkpoint=copy))
    elif how == "new session":
        ingest.drain(run.start(spark=spark.newSession()))
    else:
        ingest.drain(run.start())
    assert sorted(r["batch_id"] for r in run.table.commits().collect()) == [0, 1]
    run.verify()


def test_a_new_checkpoint_needs_a_new_writer_and_then_reads_all_again(spark, tmp_path):
    run = Run(spark, tmp_path, "crash")
    land(run.feed, run.landing, 0, 6)
    ingest.drain(run.start())
    stream = ingest.json_envelope_stream(spark, run.landing)
    fresh = str(tmp_path / "fresh")
    ingest.drain(ingest.start_ingest(stream, run.table, fresh, "w2", name="fresh"))
    # every change is there twice, and the keyed table is still right
    assert run.table.changelog().count() == 2 * CHANGELOG["crash"]
    truth = state.current_state(D.decode_upserts(run.feed))
    assert reconcile.snapshot_diff_all(truth, run.table.current()).count() == 0


def test_stream_equals_batch_and_quarantines(spark, tmp_path, sf):
    table = ChangeTable(spark, str(tmp_path / "t")).create()
    landing = str(tmp_path / "landing")
    feed = Q.events_feed(spark, sf).cache()
    feed.repartition(4).write.json(landing)
    (tmp_path / "landing" / "bad.json").write_text('{"op":"c","ts_ms":1,"source":{"pos":1}}\n{nonsense\nnull\n')
    stream = ingest.json_envelope_stream(spark, landing, max_files=2)
    query = ingest.start_ingest(stream, table, str(tmp_path / "c"), "w", name="batchlike")
    ingest.drain(query)
    assert rows(table.changelog()) == rows(D.audit_rows(D.decode(feed)))
    assert rows(table.current()) == rows(state.current_state(D.decode_upserts(feed)))
    assert rows(table.rejects(), "reject_reason") == [("malformed record",), ("missing after image",)]
    progress = ingest.progress_rows(spark, query)
    again = progress.unionByName(progress)
    history = ingest.progress_history(again)
    assert history.count() == progress.select("batch_id").distinct().count()
    done = history.filter("input_rows > 0")
    assert done.filter("trigger_ms is null or add_batch_ms is null").count() == 0


def test_union_and_dedup_streams(spark, tmp_path, sf):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    feed = Q.events_feed(spark, sf).cache()
    feed.filter("op <> 'd'").write.json(one)
    feed.write.json(two)  # delivers the first part again
    both = ingest.union_streams(ingest.json_envelope_stream(spark, one), ingest.json_envelope_stream(spark, two))
    changes = ingest.dedup_stream(D.decode(both).select(*CURRENT_COLUMNS, "cdc_row_kind", "_seq", "_img"))
    out = str(tmp_path / "out")
    query = (
        changes.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    ingest.drain(query)
    assert rows(spark.read.parquet(out), "order_id", "_seq", "_img") == rows(D.decode(feed), "order_id", "_seq", "_img")


def test_periodic_trigger_and_waiting(spark, tmp_path):
    run = Run(spark, tmp_path, "smoke")
    land(run.feed, run.landing, 0, 4)
    stream = ingest.json_envelope_stream(spark, run.landing)
    query = ingest.start_ingest(stream, run.table, run.checkpoint, "w", every_seconds=1, name="periodic")
    try:
        ingest.await_commits(query, run.table)
        with pytest.raises(TimeoutError):
            ingest.await_commits(query, run.table, commits=99, stalled_after=1)
        with pytest.raises(TimeoutError):
            ingest.drain(query, stalled_after=2)
    finally:
        query.stop()
    run.verify()


def test_a_long_backlog_is_no_standstill(spark, tmp_path):
    run = Run(spark, tmp_path, "crash")
    log = ingest.ProgressLog(spark, str(tmp_path / "progress"))
    spark.streams.addListener(log)
    try:
        for n in range(6):
            run.feed.filter(f"source.pos % 6 = {n}").coalesce(1).write.mode("append").json(run.landing)
        stream = ingest.json_envelope_stream(spark, run.landing, max_files=1)
        query = ingest.start_ingest(stream, run.table, run.checkpoint, "w", name="backlog")
        ingest.drain(query, stalled_after=8)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(log)
    run.verify()
    kept = ingest.progress_history(log.rows()).filter("input_rows > 0")
    assert kept.agg({"input_rows": "sum"}).first()[0] == run.feed.count()


def test_discard_runs_the_plan(spark):
    ingest.discard(spark.range(10))


def test_the_newest_change_of_a_key_is_all_a_stream_keeps(spark, tmp_path, sf):
    landing, out, ck = (str(tmp_path / n) for n in ("landing", "out", "ck"))
    feed = Q.events_feed(spark, sf).cache()
    keys = D.decode(feed).select("order_id").distinct().count()
    parts = [feed.filter(F.pmod(F.col("source.pos"), F.lit(3)) == n) for n in (2, 0, 1)]  # out of order
    for n, part in enumerate([*parts, feed]):  # and all of it once more
        part.coalesce(1).write.mode("append").json(landing)
        stream = D.decode(ingest.json_envelope_stream(spark, landing))
        query = ingest.start_newest(stream, out, ck)
        ingest.drain(query)
        held = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
        assert held[-1]["numRowsTotal"] <= keys and "rocksdbCommitFileSyncLatencyMs" in held[-1]["customMetrics"]
        assert n < 3 or held[-1]["numRowsTotal"] == keys
    newest = ingest.newest_rows(spark, out)
    assert rows(state.live_rows(newest)) == rows(state.current_state(D.decode(feed)))
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


DRIVER = """
import sys, time
sys.path.insert(0, sys.argv[1])
from changeflow.session import build_session
from changeflow.streaming import ingest
from changeflow.streaming.table import ChangeTable, Hooks

spark = build_session("killed", "local[2]", {"spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": sys.argv[5]})

def stuck(batch_id):
    if batch_id == 2:
        print("jvm", spark._jvm.ProcessHandle.current().pid(), flush=True)
        time.sleep(600)

table = ChangeTable(spark, sys.argv[3], hooks=Hooks(**{sys.argv[6]: stuck}))
stream = ingest.json_envelope_stream(spark, sys.argv[2], max_files=1)
ingest.drain(ingest.start_ingest(stream, table, sys.argv[4], "w"))
"""


@pytest.mark.parametrize("point", ["before_write", "before_commit"])
def test_a_fresh_driver_takes_over_from_a_killed_one(spark, tmp_path, point):
    run = Run(spark, tmp_path, "crash")
    for n in range(0, 7):
        land(run.feed, run.landing, n, n)
    (tmp_path / "driver.py").write_text(DRIVER)
    root = str(Path(__file__).resolve().parents[1])
    args = [root, run.landing, str(tmp_path / "table"), run.checkpoint, str(tmp_path / "shared"), point]
    with subprocess.Popen(
        [sys.executable, str(tmp_path / "driver.py"), *args], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True
    ) as other:
        for line in other.stdout:
            if line.startswith("jvm "):
                # In the middle of batch 2: the driver's JVM, then its Python, by their own numbers.
                os.kill(int(line.split()[1]), signal.SIGKILL)
                other.kill()
                break
    assert run.table.commits().count() == 2
    ingest.drain(run.start())
    run.verify()
