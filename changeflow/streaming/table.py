"""A change table on plain files: idempotent batches, commit log, snapshots.

Layout under the base path::

    changelog/writer_id=<w>/batch_id=<n>/*.parquet     change rows of one batch
    rejects/writer_id=<w>/batch_id=<n>/*.parquet       what could not be decoded
    commits/writer_id=<w>/block=<n div 1000>/<n>.json  one row per committed batch
    snapshots/id=<k>/{rows,coverage}                   newest change per key, and what it covers
    snapshot_log/<k>.json                              written last: the snapshot may be read

A batch writes its data first and its commit row last. Until the commit row exists no reader
sees the data and a replay may overwrite it; once it exists the batch is skipped. Commit rows are
written under a temporary name and renamed, which is atomic on HDFS and local disks. On an object
store use a table format with its own commit protocol behind the same methods.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import decode as D
from changeflow.operators import state
from changeflow.operators.maintain import data_files
from changeflow.schemas import (
    CHANGE_COLUMNS,
    CHANGELOG_COLUMNS,
    COMMIT,
    COVERAGE,
    DATA_FILE,
    SNAPSHOT_LOG,
    STORED_CHANGE,
    STORED_REJECT,
)

COMMITS_PER_BLOCK = 1_000
TARGET_BYTES = 128 * 1024 * 1024


def _no_hook(batch_id: int) -> None:
    pass


@dataclass
class Hooks:
    """Points at which a test may stop a batch; see the fault scenarios."""

    before_write: Callable[[int], None] = _no_hook
    before_commit: Callable[[int], None] = _no_hook
    after_commit: Callable[[int], None] = _no_hook


@dataclass
class ChangeTable:
    spark: SparkSession
    base: str
    max_records_per_file: int = 0
    parquet_block_bytes: int = 0
    hooks: Hooks = field(default_factory=Hooks)

    # -- files ---------------------------------------------------------------------------

    def path(self, *parts: str) -> str:
        return "/".join([self.base, *parts])

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _publish(self, path: str, row: dict) -> None:
        """Write one JSON row under a temporary name, then rename. An existing row stays."""
        fs, target = self._fs(path)
        parent = target.getParent()
        fs.mkdirs(parent)
        hidden = self.spark._jvm.org.apache.hadoop.fs.Path(parent, f"_{target.getName()}.{time.time_ns()}")
        out = fs.create(hidden, True)
        try:
            out.write(bytearray((json.dumps(row) + "\n").encode()))
        finally:
            out.close()
        if not fs.rename(hidden, target):
            fs.delete(hidden, False)
            if not fs.exists(target):
                raise OSError(f"could not publish {path}")

    def _writer(self, df: DataFrame):
        w = df.write.mode("overwrite")
        if self.max_records_per_file:
            w = w.option("maxRecordsPerFile", self.max_records_per_file)
        if self.parquet_block_bytes:
            w = w.option("parquet.block.size", self.parquet_block_bytes)
        return w

    def create(self) -> "ChangeTable":
        """Make the folders if they are absent."""
        for name in ("changelog", "rejects", "commits", "snapshots", "snapshot_log"):
            fs, p = self._fs(self.path(name))
            fs.mkdirs(p)
        return self

    # -- writing -------------------------------------------------------------------------

    def _commit_path(self, writer_id: str, batch_id: int) -> str:
        block = batch_id // COMMITS_PER_BLOCK
        return self.path("commits", f"writer_id={writer_id}", f"block={block}", f"{batch_id}.json")

    def is_committed(self, writer_id: str, batch_id: int) -> bool:
        return self.exists(self._commit_path(writer_id, batch_id))

    def append_envelopes(
        self, envelopes: DataFrame, writer_id: str, batch_id: int, mode: str = "quarantine"
    ) -> bool:
        """Decode and store one batch exactly once. False if it was committed before.

        Row counts and positions come from the write itself, so the batch is read once; only a
        batch that does hold rejects is read again to keep them.
        """
        if self.is_committed(writer_id, batch_id):
            return False
        self.hooks.before_write(batch_id)
        part = (f"writer_id={writer_id}", f"batch_id={batch_id}")
        seen = Observation()
        bad = ~D.is_good(envelopes) & ~D.is_ignored(envelopes)
        counted = envelopes.observe(seen, F.count_if(bad).alias("rejects"))
        stats = self._write_changes(D.decode(counted, mode), part)
        rejects = int(seen.get["rejects"] or 0)
        if rejects:
            self._writer(D.rejects(envelopes)).parquet(self.path("rejects", *part))
        self._commit(writer_id, batch_id, {**stats, "rejects": rejects})
        return True

    def append_changes(self, changes: DataFrame, writer_id: str, batch_id: int) -> bool:
        """Store one batch of decoded change rows exactly once."""
        if self.is_committed(writer_id, batch_id):
            return False
        self.hooks.before_write(batch_id)
        part = (f"writer_id={writer_id}", f"batch_id={batch_id}")
        stats = self._write_changes(changes.select(*CHANGE_COLUMNS), part)
        self._commit(writer_id, batch_id, {**stats, "rejects": 0})
        return True

    def _write_changes(self, changes: DataFrame, part: tuple[str, ...]) -> dict:
        wrote = Observation()
        counted = changes.observe(
            wrote,
            F.count(F.lit(1)).alias("rows"),
            F.min(D.position_order(changes, image=False)).alias("first"),
            F.max(D.position_order(changes, image=False)).alias("last"),
        )
        self._writer(counted).parquet(self.path("changelog", *part))
        seen = dict(wrote.get)
        ends = {f"{end}_{c}": at and at[f"_{c}"] for end, at in (("min", seen.pop("first")), ("max", seen.pop("last"))) for c in ("file", "seq")}
        return {**seen, **ends}

    def _commit(self, writer_id: str, batch_id: int, stats: dict) -> None:
        self.hooks.before_commit(batch_id)
        now = datetime.now(timezone.utc).isoformat(timespec="milliseconds")
        row = {"batch_id": batch_id, **stats, "committed_at": now}
        self._publish(self._commit_path(writer_id, batch_id), row)
        self.hooks.after_commit(batch_id)

    # -- reading -------------------------------------------------------------------------

    def commits(self) -> DataFrame:
        """One row per committed batch."""
        return self.spark.read.schema(COMMIT).json(self.path("commits"))

    def stored(self) -> DataFrame:
        """Everything on disk, committed or not."""
        return self.spark.read.schema(STORED_CHANGE).parquet(self.path("changelog"))

    def committed_changes(self, upto: int | None = None) -> DataFrame:
        """Change rows of committed batches. ``upto`` prunes batch folders on both sides."""
        rows, commits = self.stored(), self.commits()
        if upto is not None:
            rows, commits = rows.filter(F.col("batch_id") <= upto), commits.filter(F.col("batch_id") <= upto)
        return rows.join(commits.select("writer_id", "batch_id"), ["writer_id", "batch_id"], "left_semi")

    def changelog(self) -> DataFrame:
        """The audit table: every committed change."""
        return self.committed_changes().select(*CHANGELOG_COLUMNS)

    def rejects(self) -> DataFrame:
        """Envelopes of committed batches that could not be decoded."""
        rows = self.spark.read.schema(STORED_REJECT).parquet(self.path("rejects"))
        done = self.commits().select("writer_id", "batch_id")
        return rows.join(done, ["writer_id", "batch_id"], "left_semi")

    def as_of(self, upto: int, writer_id: str | None = None) -> DataFrame:
        """The keyed table as of batch ``upto``.

        Batch ids only order one writer's batches. In a table with several, name the writer: the
        version is then the moment at which its batch was committed, for all writers.
        """
        if writer_id is None:
            if len(self.commits().select("writer_id").distinct().limit(2).collect()) > 1:
                raise ValueError("several writers: name the one whose batch is meant")
            return state.current_state(self.committed_changes(upto).select(*CHANGE_COLUMNS))
        commits = self.commits()
        own = commits.filter((F.col("writer_id") == writer_id) & (F.col("batch_id") <= upto))
        moment = own.agg(F.max("committed_at")).first()[0]
        return state.current_state(self._changes_of(commits.filter(F.col("committed_at") <= F.lit(moment))))

    def latest_snapshot(self) -> int | None:
        """Number of the newest readable snapshot."""
        log = self.spark.read.schema(SNAPSHOT_LOG).json(self.path("snapshot_log"))
        return log.agg(F.max("snapshot_id")).first()[0]

    def _snapshot(self, snapshot_id: int) -> tuple[DataFrame, DataFrame]:
        at = self.path("snapshots", f"id={snapshot_id}")
        return (
            self.spark.read.parquet(f"{at}/rows"),
            self.spark.read.schema(COVERAGE).json(f"{at}/coverage"),
        )

    def live_commits(self, snapshot_id: int | None) -> DataFrame:
        """Committed batches that ``snapshot_id`` does not cover; all of them without one."""
        commits = self.commits()
        if snapshot_id is None:
            return commits
        _, coverage = self._snapshot(snapshot_id)
        # What was covered is listed batch by batch: ids need not be committed in order.
        return commits.join(coverage, ["writer_id", "batch_id"], "left_anti")

    def _changes_of(self, commits: DataFrame) -> DataFrame:
        """Changes of some batches. The lowest id among them prunes the folders before."""
        batches = commits.select("writer_id", "batch_id")
        lowest = batches.agg(F.min("batch_id")).first()[0]
        rows = self.stored().filter(F.col("batch_id") >= (lowest or 0))
        return rows.join(batches, ["writer_id", "batch_id"], "left_semi").select(*CHANGE_COLUMNS)

    def open_files(self, snapshot_id: int | None) -> DataFrame:
        """Every row a reader of the keyed table scans, before merging."""
        tail = self._changes_of(self.live_commits(snapshot_id))
        return tail if snapshot_id is None else self._snapshot(snapshot_id)[0].unionByName(tail)

    def latest_changes(self) -> DataFrame:
        """Newest committed change per key, deletes included."""
        found = self.latest_snapshot()
        newer = self.live_commits(found)
        tail = self._changes_of(newer)
        if found is None:
            return state.latest_by_key(tail, keep_deletes=True)
        rows, _ = self._snapshot(found)
        tail_rows = newer.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        return state.snapshot_plus_tail(rows, tail, int(tail_rows)) if tail_rows else rows

    def current(self) -> DataFrame:
        """The keyed table: eight columns, one row per live key."""
        return state.live_rows(self.latest_changes())

    # -- maintenance ---------------------------------------------------------------------

    def compact(self, target_bytes: int = TARGET_BYTES) -> dict:
        """Write the newest change per key as a new snapshot of files near ``target_bytes``.

        What the snapshot covers is fixed first. Batches committed while it is being written are
        not in it and stay in the tail, so no change is lost. Old files are left in place. Run one
        compaction of a table at a time.
        """
        previous = self.latest_snapshot()
        snapshot_id = 0 if previous is None else previous + 1
        at = self.path("snapshots", f"id={snapshot_id}")
        self.commits().select("writer_id", "batch_id").write.mode("overwrite").json(f"{at}/coverage")
        coverage = self.spark.read.schema(COVERAGE).json(f"{at}/coverage")
        size = self.live_files(previous).agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")
        ).first()
        covered = self.live_commits(previous).join(coverage, ["writer_id", "batch_id"], "left_semi")
        newest = self._changes_of(covered)
        if previous is not None:
            newest = self._snapshot(previous)[0].unionByName(newest)
        newest = state.latest_by_key(newest, keep_deletes=True)
        files = max(1, math.ceil(size["b"] / target_bytes))
        wrote = Observation()
        # The aggregate's own shuffle has no fixed number of partitions. A second one, which moves
        # one row per key, makes as many files as the target asks for, at any size.
        out = newest.repartition(files, "order_id").observe(wrote, F.count(F.lit(1)).alias("rows"))
        self._writer(out).parquet(f"{at}/rows")
        now = datetime.now(timezone.utc).isoformat(timespec="milliseconds")
        row = {"snapshot_id": snapshot_id, "rows": wrote.get["rows"], "created_at": now}
        self._publish(self.path("snapshot_log", f"{snapshot_id}.json"), row)
        added = self.files(f"{at}/rows").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b")).first()
        return {
            "snapshot_id": snapshot_id,
            "rewritten_files": size["n"],
            "added_files": added["n"],
            "rewritten_bytes": int(size["b"]),
            "added_bytes": int(added["b"] or 0),
        }

    def files(self, path: str) -> DataFrame:
        """Data files under ``path`` with their sizes; contents are never read."""
        return data_files(self.spark, path)

    def live_files(self, snapshot_id: int | None = None) -> DataFrame:
        """Files a reader of the keyed table opens: the snapshot's and those of later batches."""
        part = F.regexp_extract
        rows = self.files(self.path("changelog")).select(
            "*",
            part("path", r"/writer_id=([^/]+)/", 1).alias("writer_id"),
            part("path", r"/batch_id=([0-9]+)/", 1).cast("bigint").alias("batch_id"),
        )
        keep = self.live_commits(snapshot_id).select("writer_id", "batch_id")
        if snapshot_id is None:
            base = self.spark.createDataFrame([], DATA_FILE)
        else:
            base = self.files(self.path("snapshots", f"id={snapshot_id}", "rows"))
        return base.unionByName(
            rows.join(keep, ["writer_id", "batch_id"], "left_semi").select("path", "length")
        )

    def commit_summary(self) -> DataFrame:
        """Metadata in one row: commits, newest batch, totals. Running and added counts stay apart."""
        newest = F.max_by(F.struct("writer_id", "batch_id", "rows", "rejects"), F.struct("committed_at", "batch_id"))
        zero = F.lit(0).cast("bigint")
        return (
            self.commits()
            .agg(
                F.count(F.lit(1)).alias("commit_count"),
                newest.alias("n"),
                F.coalesce(F.sum("rows"), zero).alias("total_rows"),
                F.coalesce(F.sum("rejects"), zero).alias("total_rejects"),
                F.max(F.struct("max_file", "max_seq"))["max_seq"].alias("max_seq"),
            )
            .select(
                "commit_count",
                F.col("n.writer_id").alias("current_writer_id"),
                F.col("n.batch_id").alias("current_batch_id"),
                F.coalesce("n.rows", zero).alias("added_rows"),
                F.coalesce("n.rejects", zero).alias("added_rejects"),
                "total_rows",
                "total_rejects",
                "max_seq",
            )
        )


