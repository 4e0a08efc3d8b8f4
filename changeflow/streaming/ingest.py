"""The change stream: source, exactly-once batches, restarts, progress."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from changeflow.operators import state
from changeflow.operators.maintain import data_files
from changeflow.schemas import ENVELOPE, POSITION_COLUMNS, PROGRESS
from changeflow.streaming.table import ChangeTable

# Restart policy and trigger defaults.
RESTART_ATTEMPTS = 3
RESTART_DELAY_SECONDS = 3.0
TRIGGER_SECONDS = 30
BATCH_TIMEOUT_SECONDS = 600
QUERY_NAME = "orders-changes"
#: Streaming state on disk, one file set per partition.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Envelopes that a landing file holds at most: a compressed file is read by one task.
LANDING_ROWS = 100_000


def land(envelopes: DataFrame, path: str, batches: int = 1) -> int:
    """Write envelopes as compressed JSON files for ``batches`` batches; returns how many files each has to take.

    Rows stay with the task that made them: no envelope is shuffled, and the changes of a key that were made
    together stay together. Only where that gives fewer files than batches, so at most ``batches * LANDING_ROWS``
    rows, they are dealt out and written again.
    """

    def write(rows: DataFrame) -> int:
        out = rows.write.mode("overwrite").option("compression", "gzip").option("maxRecordsPerFile", LANDING_ROWS)
        out.json(path)
        return data_files(rows.sparkSession, path, "*.json.gz").count()

    found = write(envelopes)
    if found < batches:
        found = write(envelopes.repartition(batches, "source.pos"))
    return max(1, math.ceil(found / batches))


def json_envelopes(spark: SparkSession, path: str, schema: str = ENVELOPE) -> DataFrame:
    """Envelopes from JSON files, as a batch."""
    return spark.read.schema(schema).json(path)


def json_envelope_stream(
    spark: SparkSession, path: str, max_files: int = 1_000, schema: str = ENVELOPE
) -> DataFrame:
    """Envelopes from JSON files as they arrive; ``max_files`` per batch is the rate limit."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def value_envelopes(messages: DataFrame, column: str = "value", schema: str = ENVELOPE) -> DataFrame:
    """Envelopes from a message value (binary or text), batch or stream, such as a Kafka topic.

    A null value is no change record; text that is not JSON is kept as a malformed record.
    """
    text = F.col(column).cast("string")
    parsed = F.from_json(text, schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    return messages.select(parsed.alias("e")).select("e.*")


def kafka_envelope_stream(
    spark: SparkSession, servers: str, topic: str, max_offsets: int = 1_000_000
) -> DataFrame:
    """The same stream from a Kafka topic, where the connector is on the class path."""
    messages = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", max_offsets)
        .load()
    )
    return value_envelopes(messages)


def start_ingest(
    envelopes: DataFrame,
    table: ChangeTable,
    checkpoint: str,
    writer_id: str,
    *,
    mode: str = "quarantine",
    every_seconds: int | None = None,
    name: str = QUERY_NAME,
) -> StreamingQuery:
    """Write the stream into ``table``; both outputs of a batch share one commit row.

    Without ``every_seconds`` the query takes what is there and ends. ``writer_id`` belongs to
    the checkpoint: a new checkpoint needs a new one, and only one query may run per writer.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        table.append_envelopes(batch, writer_id, batch_id, mode)

    writer = (
        envelopes.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(store)
    )
    if every_seconds is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{every_seconds} seconds")
    return writer.start()


def drain(query: StreamingQuery, stalled_after: float = BATCH_TIMEOUT_SECONDS) -> None:
    """Wait for a query that ends by itself, however long its backlog takes.

    Only a standstill stops it: no batch finished in a whole ``stalled_after`` seconds.
    """
    finished = None
    while not query.awaitTermination(stalled_after):
        last = query.lastProgress
        now = None if last is None else (last["runId"], last["batchId"])
        if now == finished:
            query.stop()
            raise TimeoutError(f"no batch ended within {stalled_after} s")
        finished = now


def run_with_restarts(
    start: Callable[[], StreamingQuery],
    attempts: int = RESTART_ATTEMPTS,
    delay: float = RESTART_DELAY_SECONDS,
    stalled_after: float = BATCH_TIMEOUT_SECONDS,
) -> int:
    """Run a query to its end, starting it anew after a failure at most ``attempts`` times.

    Returns how many restarts it took; the last failure is raised when they are used up.
    """
    for restart in range(attempts + 1):
        try:
            drain(start(), stalled_after)
            return restart
        except StreamingQueryException:
            if restart == attempts:
                raise
            time.sleep(delay)
    raise AssertionError("unreachable")


def await_commits(
    query: StreamingQuery, table: ChangeTable, commits: int = 1, step: float = 0.2, stalled_after: float = BATCH_TIMEOUT_SECONDS
) -> None:
    """Let a running query go on until ``table`` has so many commits, however long they take.

    The query's own failure is raised as it is; one that ends, or neither ends a batch nor commits one for
    ``stalled_after`` seconds, raises too.
    """
    seen, since = None, time.monotonic()
    while True:
        ended = query.awaitTermination(step)
        found = table.commits().count()
        if found >= commits:
            return
        if ended:
            raise RuntimeError("the query ended before the commits were there")
        last = query.lastProgress
        now = found, None if last is None else (last["runId"], last["batchId"], last["numInputRows"] > 0)
        if now != seen:
            seen, since = now, time.monotonic()
        elif time.monotonic() - since > stalled_after:
            raise TimeoutError(f"fewer than {commits} commits, and none in {stalled_after} s")


class FailOnce:
    """A hook that raises the first time batch ``batch_id`` passes it."""

    def __init__(self, batch_id: int, message: str = "injected fault"):
        self.batch_id, self.message, self.fired = batch_id, message, False

    def __call__(self, batch_id: int) -> None:
        if batch_id == self.batch_id and not self.fired:
            self.fired = True
            raise RuntimeError(self.message)


class ProgressLog(StreamingQueryListener):
    """Keeps every progress report of every query as one JSON document under ``path``.

    The engine itself remembers only the last reports. ``spark.streams.addListener(log)`` starts
    it; ``log.rows()`` reads what there is.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        report = event.progress
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path, f"{report.runId}-{report.batchId}-{time.time_ns()}.json")
        out = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).create(at, True)
        try:
            out.write(bytearray((" ".join(report.json.split()) + "\n").encode()))
        finally:
            out.close()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def rows(self) -> DataFrame:
        """The reports as rows."""
        took = "durationMs struct<triggerExecution: bigint, addBatch: bigint, walCommit: bigint, commitOffsets: bigint>"
        schema = f"runId string, batchId bigint, timestamp string, numInputRows bigint, inputRowsPerSecond double, {took}"
        fields = ("runId", "batchId", "timestamp", "numInputRows", "inputRowsPerSecond")
        fields += tuple(f"durationMs.{k}" for k in ("triggerExecution", "addBatch", "walCommit", "commitOffsets"))
        wanted = StructType.fromDDL(PROGRESS)
        read = self.spark.read.schema(schema).json(self.path)
        return read.select(*[F.col(c).cast(f.dataType).alias(f.name) for c, f in zip(fields, wanted, strict=True)])


def progress_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The engine's recent progress reports (a bounded list) as rows; ProgressLog keeps all."""
    rows = []
    for p in query.recentProgress:
        took = p["durationMs"]
        rate = p["inputRowsPerSecond"]
        rows.append(
            (
                str(p["runId"]),
                int(p["batchId"]),
                p["timestamp"],
                int(p["numInputRows"]),
                None if rate is None else float(rate),
                *[
                    None if took.get(k) is None else int(took[k])
                    for k in ("triggerExecution", "addBatch", "walCommit", "commitOffsets")
                ],
            )
        )
    return spark.createDataFrame(rows, PROGRESS)


def progress_history(rows: DataFrame) -> DataFrame:
    """Each (run, batch) once."""
    return rows.dropDuplicates(["run_id", "batch_id"])


def union_streams(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.unionByName(right)


def dedup_stream(changes: DataFrame) -> DataFrame:
    """Drop repeated deliveries of a change.

    The state store keeps every position seen, so it grows with the log. Where only the newest
    change of a key is wanted, :func:`start_newest` keeps one row a key.
    """
    return changes.dropDuplicates(["order_id", *[c for c in POSITION_COLUMNS if c in changes.columns], "_img"])


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB; a query keeps the settings it was started with."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def start_newest(
    changes: DataFrame, path: str, checkpoint: str, name: str = "changeflow-newest", key: str = "order_id"
) -> StreamingQuery:
    """Keep the newest change of every key of a stream, repeats and late older changes left out.

    A streaming aggregate in update mode: its state, in RocksDB and so on disk, holds one row per
    key, whatever the log's length. Each batch writes the keys it touched to ``path/batch=<n>``, a replay the
    same again. A change older than what its key has already is not written: the newest is, again.
    Read the result with :func:`newest_rows`.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with state_on_disk(changes.sparkSession):
        return (
            state.latest_by_key(changes, key, keep_deletes=True)
            .writeStream.queryName(name)
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(store)
            .start()
        )


def newest_rows(spark: SparkSession, path: str) -> DataFrame:
    """The newest change of every key that :func:`start_newest` has written, deletes included."""
    return state.latest_by_key(spark.read.parquet(path).drop("batch"), keep_deletes=True)


def discard(df: DataFrame) -> None:
    """Run a batch plan to its end and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
