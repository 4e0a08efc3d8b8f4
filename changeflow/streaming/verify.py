"""End-to-end checks of the pipeline: faults, small files, load. Each ends in evidence rows.

These are the library's own jobs run against scripted or generated changes: ingest with a fault,
restart, reconcile; many small batches, compact, compare layouts; a spike under a rate limit,
sampled until it has drained.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import decode, maintain, reconcile, runmetrics, state
from changeflow.operators.evidence import utc_now
from changeflow.plans.sqlapi import FAILURE_CLASSES
from changeflow.sources import feeds
from changeflow.streaming import ingest
from changeflow.streaming.table import ChangeTable, Hooks

# Which script a failure class runs, where it fails or how it is restored.
FAULT_POINT = {
    "task-crash": "before_write",
    "checkpoint-restore": None,
    "jobmanager-restart": None,
    "savepoint-restore": None,
    "sink-commit-fault": "before_commit",
}
SCRIPT = {name: "crash" if point else "restore" for name, point in FAULT_POINT.items()}
RESTORE = {"checkpoint-restore": "checkpoint", "savepoint-restore": "copy", "jobmanager-restart": "session"}


def _copy_folder(spark: SparkSession, source: str, target: str) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(
        a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf
    )


def _known(way: str) -> None:
    if way not in RESTORE.values():
        raise ValueError(f"unknown way to restore: {way}")


def interrupted_ingest(
    spark: SparkSession, feed: DataFrame, base: str, way: str, files: int = 6, writer_id: str = "verify"
) -> ChangeTable:
    """Land ``feed`` as a backlog of ``files`` batches, ingest it and stop, restore and finish: see
    :func:`interrupted_landing`.
    """
    _known(way)
    landing = f"{base}/landing"
    return interrupted_landing(spark, landing, ingest.land(feed, landing, files), base, way, writer_id)


def interrupted_landing(
    spark: SparkSession, landing: str, max_files: int, base: str, way: str, writer_id: str = "verify"
) -> ChangeTable:
    """Ingest the files of ``landing``, stop the running query in the middle of its backlog, restore and finish.

    ``way``: start again from the same ``checkpoint``, from a ``copy`` of it, or in a new
    ``session`` that opens the table itself. The backlog is ``max_files`` a batch; the query is stopped
    once its first batch is committed, whatever it is doing then. Returns the restored table.
    """
    _known(way)
    table = ChangeTable(spark, base).create()
    checkpoint = f"{base}/checkpoint"

    def start(owner: ChangeTable, at: str, **trigger):
        stream = ingest.json_envelope_stream(owner.spark, landing, max_files=max_files)
        return ingest.start_ingest(stream, owner, at, writer_id, name=f"interrupted-{way}", **trigger)

    running = start(table, checkpoint, every_seconds=0)
    try:
        ingest.await_commits(running, table)
    finally:
        running.stop()
    if way == "copy":
        _copy_folder(spark, checkpoint, f"{base}/savepoint")
        checkpoint = f"{base}/savepoint"
    elif way == "session":
        table = ChangeTable(spark.newSession(), base)
    ingest.run_with_restarts(lambda: start(table, checkpoint), delay=0.1)
    return table


def verify_failure(spark: SparkSession, failure_class: str, runs: DataFrame, base: str) -> DataFrame:
    """Run the class's script for every ``scenario_id`` of ``runs`` and reconcile all of them.

    One result row: diff counts and audit of the whole table, and the scenario count.
    """
    if failure_class not in FAILURE_CLASSES:
        raise ValueError(f"unsupported failure class: {failure_class}")
    point, kind = FAULT_POINT[failure_class], SCRIPT[failure_class]
    feed = feeds.scenario_feed(runs.select("scenario_id", F.lit(kind).alias("kind")))
    home, restarts = f"{base}/{failure_class}", 0
    if point:
        table = ChangeTable(spark, home, hooks=Hooks(**{point: ingest.FailOnce(1)})).create()
        landing = f"{home}/landing"

        def start():
            stream = ingest.json_envelope_stream(spark, landing)
            return ingest.start_ingest(
                stream, table, f"{home}/checkpoint", "verify", name=f"verify-{failure_class}"
            )

        step = F.col("source.pos") % 16
        feed.filter(step < 3).write.mode("append").json(landing)
        ingest.drain(start())
        feed.filter(step >= 3).write.mode("append").json(landing)
        restarts = ingest.run_with_restarts(start, delay=0.1)
    else:
        # Read back through the first session: what another one committed is in the files.
        restored = interrupted_ingest(spark, feed, home, RESTORE[failure_class])
        table = ChangeTable(spark, restored.base)

    truth = state.current_state(decode.decode_upserts(feed))
    wanted = decode.decode(feed).select("event_id")
    summary = reconcile.reconcile_summary(
        truth, table.current(), truth, table.changelog(), wanted
    )
    return summary.select(
        F.lit(failure_class).alias("failure_class"),
        F.lit(restarts).alias("restarts"),
        "snapshot_diff_count",
        "multiset_diff_count",
        "changelog_row_count",
        "consistent",
        F.when(F.lit(bool(point)) & (F.lit(restarts) == 0), "the fault did not fire").alias("error"),
    )


def verify_failures(spark: SparkSession, classes: list[str], runs: DataFrame, base: str) -> DataFrame:
    """One result row per failure class."""
    out = None
    for name in classes:
        row = verify_failure(spark, name, runs, base)
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("name at least one failure class")
    return out


@dataclass(frozen=True)
class RewriteProfile:
    batches: int = 12
    rows_per_batch: int = 50


@dataclass(frozen=True)
class LoadProfile:
    spike_events: int = 500
    files: int = 10
    baseline_samples: int = 2
    poll_seconds: float = 0.5


def _generated(spark: SparkSession, n: int) -> DataFrame:
    """``n`` create envelopes at positions 1 … n."""
    rows = feeds.sequence_orders(
        spark.range(1, n + 1), "id", base_event_id=0, prefix="order-", customer_base=10_000,
        amount_base=25_000, seed=222,
    )
    image = F.struct(*rows.columns)
    return feeds.envelopes(
        rows, op=F.lit("c"), ts_ms=F.lit(0).cast("bigint"), before=F.when(F.lit(False), image),
        after=image, seq=F.col("event_id"),
    )


def rewrite_small_files(spark: SparkSession, profile: RewriteProfile, base: str) -> DataFrame:
    """Many small batches, then compaction: layouts before and after, deltas and checks.

    Commit counts are of what a reader must look at; a snapshot replaces the batches it covers.
    """
    table = ChangeTable(spark, base).create()
    landing = f"{base}/landing"
    feed = _generated(spark, profile.batches * profile.rows_per_batch)
    feed.repartitionByRange(profile.batches, "source.pos").write.json(landing)
    stream = ingest.json_envelope_stream(spark, landing, max_files=1)
    ingest.drain(ingest.start_ingest(stream, table, f"{base}/checkpoint", "rewrite", name="rewrite"))
    before = maintain.file_layout(table)
    table.compact()
    after = maintain.file_layout(table)
    key = F.lit("orders").alias("table")
    deltas = maintain.layout_deltas(before.select(key, "*"), after.select(key, "*"), "table")
    counts = before.select(F.col("data_file_count").alias("files_before"), F.lit(None).cast("int").alias("files_after"))
    counts = counts.unionByName(
        after.select(F.lit(None).cast("int").alias("files_before"), F.col("data_file_count").alias("files_after"))
    ).agg(F.max("files_before").alias("files_before"), F.max("files_after").alias("files_after"))
    both = deltas.unionByName(counts, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def run_under_load(spark: SparkSession, profile: LoadProfile, base: str) -> tuple[DataFrame, DataFrame]:
    """A spike read one file at a time, sampled until the lag is gone: samples and their summary.

    The engine has no barrier alignment; the time from trigger to commit stands for it.
    """
    table = ChangeTable(spark, base).create()
    landing, checkpoint = f"{base}/landing", f"{base}/checkpoint"
    calm = _generated(spark, 1)
    calm.coalesce(1).write.mode("append").json(landing)
    stream = ingest.json_envelope_stream(spark, landing, max_files=1)
    query = ingest.start_ingest(stream, table, checkpoint, "load", every_seconds=0, name="load")
    samples: list[tuple] = []
    began = time.monotonic()

    def sample(phase: str | None) -> int:
        source = ingest.json_envelopes(spark, landing).select("after.event_id")
        lag = reconcile.commit_lag(source, table.changelog()).first()
        last = query.lastProgress
        took = last["durationMs"] if last and last["numInputRows"] else {}
        label = phase or (runmetrics.LOADED if lag["lag_events"] > 0 else runmetrics.RECOVERY)
        busy = took.get("addBatch")
        samples.append(
            (
                len(samples), label, utc_now(), int((time.monotonic() - began) * 1000),
                None if not took else float(took["triggerExecution"]),
                None if busy is None else float(took["triggerExecution"] - busy),
                0.0 if query.exception() is None else 1.0,
                min(1.0, lag["lag_events"] / profile.spike_events),
                int(lag["lag_events"]),
            )
        )
        return int(lag["lag_events"])

    try:
        ingest.await_commits(query, table)
        for _ in range(profile.baseline_samples):
            sample(runmetrics.BASELINE)
            time.sleep(profile.poll_seconds)
        spike = _generated(spark, profile.spike_events + 1).filter(F.col("source.pos") > 1)
        spike.repartition(profile.files).write.mode("append").json(landing)
        streak = 0
        # Sampled until it has drained, however long that takes; a query that fails raises here.
        while streak < runmetrics.RECOVERED_AFTER:
            streak = streak + 1 if sample(None) == 0 else 0
            if query.awaitTermination(profile.poll_seconds):
                raise RuntimeError("the query ended before its lag was gone")
    finally:
        query.stop()
    schema = (
        "sample_index int, phase string, collected_at string, elapsed_ms bigint, duration_ms double, "
        "alignment_time_ms double, failed_count double, indicator double, lag_events bigint"
    )
    rows = spark.createDataFrame(samples, schema)
    return rows, runmetrics.run_summary(rows)
