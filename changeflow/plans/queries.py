"""Registered queries: each reads the given tables and runs one operator over all of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.functions import scalars as S
from changeflow.functions.ranks import dense_positions
from changeflow.functions.windows import previous_row
from changeflow.operators import decode as D
from changeflow.operators import evidence, maintain, reconcile, runmetrics, state, versions
from changeflow.plans import conformance, sqlapi
from changeflow.schemas import CHANGE_COLUMNS, CURRENT_COLUMNS, POSITION_COLUMNS
from changeflow.session import run_dir
from changeflow.sources import catalog, feeds, sqltext, statements
from changeflow.streaming import ingest, verify
from changeflow.streaming.table import ChangeTable, Hooks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.table(spark, sf, "orders")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.table(spark, sf, "events")


def orders_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.orders_feed(_orders(spark, sf))


def events_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.events_feed(_events(spark, sf))


def orders_current(spark: SparkSession, sf: str) -> DataFrame:
    return state.current_state(D.decode_upserts(orders_feed(spark, sf)))


# -- decode ------------------------------------------------------------------------------


@query
def decode_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Deep histories to change rows: creates, two rows per update, deletes."""
    return D.decode(events_feed(spark, sf))


@query
def changelog_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The append-only audit rows of the orders feed."""
    return D.audit_rows(D.decode(orders_feed(spark, sf)))


@query
def changelog_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, distinct ids and amounts per feed and operation."""
    both = (
        D.decode(orders_feed(spark, sf))
        .withColumn("feed", F.lit("orders"))
        .unionByName(D.decode(events_feed(spark, sf)).withColumn("feed", F.lit("events")))
    )
    # Ids fold to one row per (group, id) before they are counted: no group is held whole.
    by = ["feed", "cdc_row_kind", "cdc_operation"]
    ids = both.groupBy(*by, "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents")
    )
    return ids.groupBy(*by).agg(
        F.sum("n").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_event_ids"),
        F.sum("cents").alias("amount_cents"),
    )


def _damaged_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The orders feed with images lost and operations garbled by rule; every envelope is kept."""
    feed = orders_feed(spark, sf)
    key = S.floor_div(F.col("source.pos"), 4)
    lost, garbled, stray = key % 97 == 0, key % 101 == 0, key % 103 == 0
    gone = lambda c: F.when(~lost, F.col(c)).alias(c)
    return feed.select(
        F.when(garbled | stray, F.lit("x")).otherwise(F.col("op")).alias("op"),
        "ts_ms",
        gone("before"),
        gone("after"),
        F.when(garbled | ~stray, F.col("source")).alias("source"),
    )


@query
def decode_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Envelopes that cannot be decoded, with the reason; stray values are not rejects."""
    return D.rejects(_damaged_feed(spark, sf)).select("reject_reason", "op", "_seq")


@query
def decode_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """What a quarantining decode still delivers from the same damaged feed."""
    return D.decode(_damaged_feed(spark, sf)).select(
        "order_id", "event_id", "cdc_row_kind", "cdc_operation", "_seq", "_img"
    )


@query
def wide_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Newest change of every order where file numbers, offsets and rows are large, and only the file
    number tells which change is newer: offsets fall from one file to the next.
    """
    step = F.pmod(F.col("source.pos"), F.lit(4))
    place = F.struct(
        F.concat(F.lit("binlog."), (step + 600_000).cast("string")).alias("file"),
        (F.lit(5_000_000_000) + (F.lit(3) - step) * 1000).alias("pos"),
        (step + 5000).cast("int").alias("row"),
    )
    newest = state.latest_by_key(D.decode(orders_feed(spark, sf).withColumn("source", place)), keep_deletes=True)
    return newest.select(
        "order_id", "event_id", "cdc_row_kind",
        F.col("_file").alias("log_file"), F.col("_seq").alias("log_offset"), F.col("_row").alias("log_row"),
    )


STATEMENTS = (
    "UPDATE orders_now AS o SET status = 'checked', o.amount_cents = o.amount_cents + 1 WHERE o.order_id % 3 = 0",
    """DELETE FROM orders_now WHERE status = 'created'
       AND customer_id IN (SELECT customer_id FROM orders_now WHERE status = 'checked')""",
    """INSERT INTO orders_now SELECT order_id + 100000000, concat(business_key, '-again'), event_id + 1000000000,
              customer_id, upper(status), amount_cents * 2, updated_at, seed
       FROM orders_now WHERE order_id % 5 = 1""",
    """INSERT INTO orders_now (order_id, business_key, event_id, customer_id, status, amount_cents, updated_at, seed)
       VALUES (-1, 'first', -1, 1, 'CREATED', 100, TIMESTAMP_NTZ'2026-01-01 00:00:00', 7),
              (-2, 'second', -2, 1, 'CREATED', 200, TIMESTAMP_NTZ'2026-01-01 00:00:01', 7)""",
    "UPDATE orders_now SET status = lower(status) WHERE order_id > 100000000 OR order_id < 0",
    "TRUNCATE TABLE orders_now",
)


@query
def statement_text(spark: SparkSession, sf: str) -> DataFrame:
    """A script of SQL text over the orders: every change row it makes, with statement and position."""
    orders_current(spark, sf).createOrReplaceTempView("orders_now")
    try:
        changes = D.decode(sqltext.run_script(spark, list(STATEMENTS), "orders_now"))
    finally:
        spark.catalog.dropTempView("orders_now")
    return changes.select(
        F.col("_file").alias("statement"), F.col("_seq").alias("position"), "cdc_row_kind", "order_id", "event_id", "status", "amount_cents"
    )


@query
def coerce_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    """Event times as epoch milliseconds, microseconds and texts, all read back."""
    e = _events(spark, sf)
    micros = S.epoch_micros(F.col("ts"))
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return e.select(
        "event_id",
        S.number_to_timestamp(S.floor_div(micros, 1000)).alias("from_millis"),
        S.number_to_timestamp(micros).alias("from_micros"),
        S.number_to_timestamp(-S.floor_div(micros, 1000)).alias("from_negative"),
        S.text_to_timestamp(text).alias("from_text"),
        S.text_to_timestamp(F.concat(F.translate(text, " ", "T"), F.lit("Z"))).alias("from_instant"),
        S.text_to_timestamp(F.substring_index(text, ".", 1)).alias("from_seconds"),
        S.text_to_timestamp(F.concat(text, F.lit("+02:00"))).alias("from_unreadable"),
        S.ms_text(F.col("ts")).alias("ms_text"),
        S.ms_text_from_text(F.substring(text, 1, 21)).alias("padded_text"),
    )


# -- keyed state -------------------------------------------------------------------------


@query
def current_state(spark: SparkSession, sf: str) -> DataFrame:
    """Newest row per live order."""
    return orders_current(spark, sf)


@query
def current_state_events(spark: SparkSession, sf: str) -> DataFrame:
    """Newest row per live user of the deep histories."""
    return state.current_state(D.decode_upserts(events_feed(spark, sf)))


@query
def current_state_rekeyed(spark: SparkSession, sf: str) -> DataFrame:
    """Updates that move a key: the strict mode deletes the old key, the default keeps it. Deletes
    meet the moved key."""
    feed = orders_feed(spark, sf)
    moved = F.when(F.col("op") == "u", -F.col("after.order_id") - 1).otherwise(F.col("after.order_id"))
    shift = F.col("after").withField("order_id", moved)
    gone = F.when(F.col("op") == "d", -F.col("before.order_id") - 1).otherwise(F.col("before.order_id"))
    rekeyed = feed.withColumn("after", shift).withColumn("before", F.col("before").withField("order_id", gone))
    out = None
    for mode in ("reference", "strict"):
        rows = state.current_state(D.decode_upserts(rekeyed, rekey=mode)).select(
            F.lit(mode).alias("mode"), "order_id", "event_id", "amount_cents"
        )
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def out_of_order(spark: SparkSession, sf: str) -> DataFrame:
    """The same state from the feed in another arrival order."""
    feed = orders_feed(spark, sf).repartition(F.xxhash64("source.pos"))
    return state.current_state(D.decode_upserts(feed))


@query
def source_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The eight source columns by key, initial rows and later changes together."""
    # Orders as they were first, read as a snapshot, then the log on top.
    feed = orders_feed(spark, sf)
    first = feeds.snapshot_feed(feed.filter("op = 'c'").select("after.*"))
    log = feed.filter("op <> 'c'")
    both = D.decode_upserts(first).unionByName(D.decode_upserts(log))
    return state.current_state(both).orderBy("order_id")


@query
def merge_on_read(spark: SparkSession, sf: str) -> DataFrame:
    """Data rows and equality deletes, merged when read."""
    data, deletes = state.upsert_files(D.decode(events_feed(spark, sf)))
    return state.apply_equality_deletes(data, deletes).select(*CURRENT_COLUMNS)


VERSION = 19_737  # days since the epoch: 2024-01-15


def _batched(spark: SparkSession, sf: str) -> DataFrame:
    """The deep histories in daily batches."""
    day = S.floor_div(F.col("source_ts_ms"), 86_400_000)
    return D.decode(events_feed(spark, sf)).withColumn("batch_id", day.cast("bigint"))


@query
def as_of_version(spark: SparkSession, sf: str) -> DataFrame:
    """The keyed table as a reader of an older version saw it."""
    return state.as_of(_batched(spark, sf), VERSION)


@query
def snapshot_plus_tail(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot as of one version and the changes after it, read together."""
    rows = _batched(spark, sf)
    early, late = rows.filter(F.col("batch_id") <= VERSION), rows.filter(F.col("batch_id") > VERSION)
    snapshot = state.latest_by_key(early.select(*CHANGE_COLUMNS), keep_deletes=True)
    return state.live_rows(state.snapshot_plus_tail(snapshot, late))


@query
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    """The newest numbered checkpoint path of every user; other paths do not count."""
    e = _events(spark, sf)
    leaf = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("tmp-"), F.col("event_id")))
        .when(F.col("event_type") == "view", F.lit("chk-none"))
        .otherwise(F.concat(F.lit("chk-"), F.col("event_id")))
    )
    path = F.concat(F.lit("file:/state/"), F.col("user_id"), F.lit("/"), leaf)
    numbered = e.select("user_id", path.alias("path"), S.checkpoint_number(path).alias("checkpoint_id"))
    return (
        numbered.groupBy("user_id")
        .agg(
            F.max("checkpoint_id").alias("checkpoint_id"),
            F.max_by("path", "checkpoint_id").alias("path"),
        )
        .filter("checkpoint_id is not null")
        .select("user_id", "checkpoint_id", S.state_path(F.col("path")).alias("external_path"))
    )


# -- tables on storage -------------------------------------------------------------------


def _table(spark: SparkSession, name: str, hooks: Hooks | None = None) -> ChangeTable:
    return ChangeTable(spark, run_dir(spark, name), hooks=hooks or Hooks()).create()


@query
def table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Store the feed, then query the keyed table by name with plain SQL."""
    table = _table(spark, "table-scan")
    table.append_envelopes(orders_feed(spark, sf), "load", 0)
    sqlapi.register(spark, table)
    return sqlapi.sql(
        spark,
        f"""SELECT order_id, business_key, status, amount_cents, updated_at
            FROM {sqlapi.CURRENT_VIEW} WHERE amount_cents >= 20000000""",
    )


@query
def committed_only(spark: SparkSession, sf: str) -> DataFrame:
    """A batch that failed before its commit row leaves files nobody reads."""
    hooks = Hooks(before_commit=ingest.FailOnce(1))
    table = _table(spark, "committed-only", hooks)
    feed = orders_feed(spark, sf)
    table.append_envelopes(feed.filter("op = 'c'"), "w", 0)
    try:
        table.append_envelopes(feed.filter("op <> 'c'"), "w", 1)
    except RuntimeError:
        pass
    return table.changelog()


@query
def replay_once(spark: SparkSession, sf: str) -> DataFrame:
    """A batch that failed before its commit row, replayed, then delivered once more."""
    hooks = Hooks(before_commit=ingest.FailOnce(1))
    table = _table(spark, "replay-once", hooks)
    feed = orders_feed(spark, sf)
    table.append_envelopes(feed.filter("op = 'c'"), "w", 0)
    for _ in range(3):
        try:
            table.append_envelopes(feed.filter("op <> 'c'"), "w", 1)
        except RuntimeError:
            continue
    return table.changelog()


@query
def compacted_state(spark: SparkSession, sf: str) -> DataFrame:
    """Compact after the first batch, add a second, read snapshot and tail."""
    table = _table(spark, "compacted")
    feed = orders_feed(spark, sf)
    table.append_envelopes(feed.filter("op = 'c'"), "w", 0)
    table.compact()
    table.append_envelopes(feed.filter("op <> 'c'"), "w", 1)
    return table.current()


@query
def late_batch_state(spark: SparkSession, sf: str) -> DataFrame:
    """A batch with a lower id than one that a compaction has covered is committed after it."""
    table = _table(spark, "late")
    feed = orders_feed(spark, sf)
    table.append_envelopes(feed.filter("op <> 'c'"), "w", 5)
    table.compact()
    table.append_envelopes(feed.filter("op = 'c'"), "w", 3)
    return table.current()


@query
def commit_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Commits, rows and positions from the commit log alone."""
    table = _table(spark, "summary")
    feed = _damaged_feed(spark, sf)
    table.append_envelopes(feed.filter("op = 'c'"), "w", 0)
    table.append_envelopes(feed.filter("op <> 'c'"), "w", 1)
    return table.commit_summary()


def _stream(spark: SparkSession, sf: str, name: str, hooks: Hooks | None = None) -> ChangeTable:
    """Write the orders feed as JSON files and stream them into a table, several per batch."""
    table = _table(spark, name, hooks)
    landing, checkpoint = f"{table.base}/landing", f"{table.base}/checkpoint"
    a_batch = ingest.land(orders_feed(spark, sf), landing, batches=3)

    def start():
        stream = ingest.json_envelope_stream(spark, landing, max_files=a_batch)
        return ingest.start_ingest(stream, table, checkpoint, "stream", name=name)

    ingest.run_with_restarts(start, delay=0.1)
    return table


@query
def stream_changelog(spark: SparkSession, sf: str) -> DataFrame:
    """The audit table as the stream wrote it over several batches."""
    return _stream(spark, sf, "stream-changelog").changelog()


@query
def stream_recovered_state(spark: SparkSession, sf: str) -> DataFrame:
    """The keyed table after a stream that failed between data and commit, and restarted."""
    hooks = Hooks(before_commit=ingest.FailOnce(1))
    return _stream(spark, sf, "stream-recovered", hooks).current()


@query
def restored_state(spark: SparkSession, sf: str) -> DataFrame:
    """The keyed table after a running stream was stopped mid-backlog, for each way of restoring it."""
    out, landing = None, run_dir(spark, "restored-landing")
    a_batch = ingest.land(orders_feed(spark, sf), landing, batches=4)
    for way in verify.RESTORE.values():
        base = run_dir(spark, f"restored-{way}")
        restored = verify.interrupted_landing(spark, landing, a_batch, base, way)
        rows = ChangeTable(spark, restored.base).current().withColumn("way", F.lit(way))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def union_dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams that deliver the same changes, one of them without deletes: every change once."""
    base = run_dir(spark, "union-dedup")
    ingest.land(orders_feed(spark, sf), f"{base}/landing")
    some, every = (ingest.json_envelope_stream(spark, f"{base}/landing") for _ in range(2))
    changes = ingest.dedup_stream(D.decode(ingest.union_streams(some.filter("op <> 'd'"), every)))
    out = changes.writeStream.format("parquet").option("path", f"{base}/out")
    with ingest.state_on_disk(spark):
        running = out.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    ingest.drain(running)
    return D.audit_rows(spark.read.parquet(f"{base}/out"))


@query
def newest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Two streams that deliver the same changes in several batches; the state holds one row a key."""
    base = run_dir(spark, "newest")
    a_batch = ingest.land(orders_feed(spark, sf), f"{base}/landing", batches=4)
    some, every = (ingest.json_envelope_stream(spark, f"{base}/landing", max_files=a_batch) for _ in range(2))
    changes = D.decode(ingest.union_streams(some.filter("op <> 'd'"), every))
    ingest.drain(ingest.start_newest(changes, f"{base}/out", f"{base}/checkpoint"))
    return state.live_rows(ingest.newest_rows(spark, f"{base}/out"))


@query
def numbered_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The orders as of the second of three versions that two writers committed, whatever their clocks said."""
    path = run_dir(spark, "versions")
    log = D.decode(orders_feed(spark, sf))
    step = F.pmod(F.col("_seq"), F.lit(4))
    for part in (step == 0, step == 1, step > 1):
        versions.commit(log.filter(part), path)
    return versions.as_of(spark, path, 2)


@query
def progress_history(spark: SparkSession, sf: str) -> DataFrame:
    """What a run's own progress reports say, all of them kept: rows read, and batches without a duration."""
    base = run_dir(spark, "progress")
    orders_feed(spark, sf).write.json(f"{base}/landing")
    log = ingest.ProgressLog(spark, f"{base}/reports")
    spark.streams.addListener(log)
    try:
        stream = ingest.json_envelope_stream(spark, f"{base}/landing", max_files=1)
        out = D.decode(stream).writeStream.format("parquet").option("path", f"{base}/out")
        ingest.drain(out.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    reports = ingest.progress_history(log.rows())
    lacking = F.col("trigger_ms").isNull() | F.col("add_batch_ms").isNull() | F.col("wal_commit_ms").isNull()
    return reports.filter("input_rows > 0").agg(
        F.sum("input_rows").alias("input_rows"),
        F.count_if(lacking).alias("without_durations"),
        (F.count(F.lit(1)) == F.max("batch_id") - F.min("batch_id") + 1).alias("batches_in_a_row"),
    )


@query
def bulk_load(spark: SparkSession, sf: str) -> DataFrame:
    """The current orders in files of at most 1000 rows, and what a listing of these files says of them."""
    path = run_dir(spark, "bulk")
    feeds.write_orders(orders_current(spark, sf), path, rows_per_file=1_000)
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("size"), F.sum("amount_cents").alias("cents")
    )
    name = F.element_at(F.split("path", "/"), -1)
    listed = maintain.data_files(spark, path).select(name.alias("name"), "length")
    return rows.withColumn("name", name).join(listed, "name", "full").agg(
        F.sum("rows").alias("row_count"),
        F.sum("cents").alias("amount_cents"),
        F.every(F.col("rows") <= 1_000).alias("files_bounded"),
        F.every(F.coalesce(F.col("size") == F.col("length"), F.lit(False))).alias("sizes_agree"),
    )


@query
def sorted_diff(spark: SparkSession, sf: str) -> DataFrame:
    """The differing rows of each side with their place in key order."""
    rows = orders_current(spark, sf)
    diff = reconcile.snapshot_diff(rows, damage(rows)).select("side", "order_id", "event_id", "amount_cents")
    return dense_positions(diff.withColumn("_key", F.col("order_id") * 2 + (F.col("side") == "unexpected").cast("int")), "_key", "place").select(
        "place", "side", "order_id", "event_id", "amount_cents"
    ).orderBy("place")


@query
def table_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Both catalog tables loaded, made again in vain, reset, and loaded with the creates alone."""
    base = run_dir(spark, "catalog")
    namespace = f"reset_{base[-32:]}"
    current, log = orders_current(spark, sf), D.audit_rows(D.decode(orders_feed(spark, sf)))
    try:
        names = catalog.create_tables(spark, namespace, base)
        count = lambda when: [
            spark.table(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(when).alias("step"), F.lit(n.split(".")[1]).alias("table_name"), "rows")
            for n in names
        ]
        load = lambda rows, name: rows.write.insertInto(f"{namespace}.{name}")
        steps = []
        load(current, "orders_current")
        load(log, "orders_changelog")
        catalog.create_tables(spark, namespace)
        steps += count("loaded")
        report = reduce(DataFrame.unionByName, steps)
        report.write.parquet(f"{base}-report/1")
        catalog.reset_tables(spark, namespace)
        reduce(DataFrame.unionByName, count("reset")).write.parquet(f"{base}-report/2")
        load(log.filter("cdc_operation = 'insert'"), "orders_changelog")
        reduce(DataFrame.unionByName, count("reloaded")).write.parquet(f"{base}-report/3")
    finally:
        catalog.drop_namespace(spark, namespace)
    return spark.read.parquet(*[f"{base}-report/{n}" for n in (1, 2, 3)])


@query
def written_records(spark: SparkSession, sf: str) -> DataFrame:
    """Stamped result records, written and read back: which required fields each one has."""
    path = run_dir(spark, "records")
    stamp = evidence.provenance(spark, "orders by status", logs="none")
    results = orders_current(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("orders"))
    evidence.write_record(results, stamp, path)
    docs = spark.read.json(path)
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in evidence.REQUIRED]))
    return docs.select("status", "orders", F.array_join(missing, ",").alias("missing"))


@query
def statement_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What an update of every third order and a delete of every other third write to the log."""
    path, third = run_dir(spark, "statement-changes"), F.col("order_id") % 3
    # Both statements read the table twice, to number its rows and to write them: it is made once.
    orders_current(spark, sf).write.parquet(path)
    now = spark.read.parquet(path)
    new = {"status": F.lit("checked"), "amount_cents": F.col("amount_cents") + 1}
    changed = statements.update(now, third == 0, new, first_seq=1)
    gone = statements.delete(now, third == 1, first_seq=1 << 40)
    return D.decode(changed.unionByName(gone)).select(
        "order_id", "event_id", "status", "amount_cents", "cdc_row_kind", F.col("_seq").alias("position")
    )


# -- reconciliation ----------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """A wrong copy of a table, by rule: rows lost, amounts changed, rows doubled, ghosts added.

    One pass: every row says which copies of it exist. (Outer, so that no predicate moves below
    the aggregate that made ``rows``, and its shuffle can be shared with the right table.)
    """
    key = F.col("order_id")
    kept, ghost = key % 17 != 3, F.lit("ghost")
    copies = F.array(
        F.when(kept, "kept"), F.when(kept & (key % 23 == 7), "again"), F.when(key % 29 == 11, ghost)
    )
    out = rows.withColumn("_copy", F.explode_outer(F.array_compact(copies))).filter("_copy is not null")
    is_ghost = F.col("_copy") == ghost
    changed = F.when(~is_ghost & (key % 19 == 5), 1).otherwise(0)
    return out.select(
        F.when(is_ghost, -key - 1).otherwise(key).alias("order_id"),
        "business_key",
        F.when(is_ghost, -F.col("event_id") - 1).otherwise(F.col("event_id")).alias("event_id"),
        "customer_id",
        "status",
        (F.col("amount_cents") + changed).alias("amount_cents"),
        "updated_at",
        "seed",
    )


@query
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Rows on one side only, copies ignored."""
    rows = orders_current(spark, sf)
    return reconcile.snapshot_diff(rows, damage(rows))


@query
def snapshot_diff_all(spark: SparkSession, sf: str) -> DataFrame:
    """Rows on one side only, copies counted."""
    rows = orders_current(spark, sf)
    return reconcile.snapshot_diff_all(rows, damage(rows))


@query
def canonical_diff(spark: SparkSession, sf: str) -> DataFrame:
    """JSON documents whose target copy has other key orders, blanks and number forms, and some real changes."""
    e = _events(spark, sf)
    n = F.col("event_id")
    cents = F.round(F.col("value") * 100).cast("bigint")
    written = F.format_string("%d.%02d", S.floor_div(cents, 100), F.pmod(cents, F.lit(100)))
    source = F.format_string(
        '{"kind": "%s", "id": %d, "amount": %s, "nested": {"list": [{"b": %d, "a": [1.0, null]}], "k": "\\u0041"}}',
        "event_type", n, written, n % 7,
    )
    changed = cents + F.when(n % 19 == 5, 1).otherwise(0)
    target = F.format_string(
        '{"nested":{"k":"A","list":[{"a":[1,null],"b":%de0}]},"amount":%de-2,"id":%d,"kind":"%s"}', n % 7, changed, n, "event_type"
    )
    return reconcile.canonical_diff(
        e.select(source.alias("doc")), e.filter(n % 17 != 3).select(target.alias("doc")), "doc"
    )


@query
def column_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What is wrong with each key."""
    rows = orders_current(spark, sf)
    return reconcile.column_diff(rows, damage(rows))


@query
def column_diff_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Keys with two rows on either side, of which one differs: as many rows, other contents."""
    rows = orders_current(spark, sf)
    some, other = F.col("order_id") % 5 == 0, rows.withColumn("amount_cents", F.col("amount_cents") + 1)
    left = rows.unionByName(other.filter(some))
    right = rows.filter(~some).unionByName(other.filter(some)).unionByName(other.filter(some))
    return reconcile.column_diff(left, right)


def _expected_ids(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Current ids and changelog ids straight from the orders, without any change record."""
    o = _orders(spark, sf).select(
        F.col("o_orderkey").alias("k"),
        F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("u"),
        ((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0)).alias("gone"),
    )
    current = o.filter(~F.col("gone")).select((F.col("k") * 4 + F.col("u")).alias("event_id"))
    # Image i shows when it is written and once more when the next change replaces it.
    shown = F.when((F.col("i") < F.col("u")) | F.col("gone"), 2).otherwise(1)
    log = (
        o.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("u"))))
        .withColumn("_n", F.explode(F.sequence(F.lit(1), shown)))
        .select((F.col("k") * 4 + F.col("i")).alias("event_id"))
    )
    return current, log


def _two_cases(spark: SparkSession, sf: str, check) -> DataFrame:
    """One row for the right table and one for the damaged one, audited side by side."""
    both = lambda df: df.withColumn("target", F.explode(F.array(F.lit("clean"), F.lit("damaged"))))
    rows = orders_current(spark, sf)
    wrong = damage(rows).withColumn("target", F.lit("damaged"))
    found = rows.withColumn("target", F.lit("clean")).unionByName(wrong)
    log = both(D.decode(orders_feed(spark, sf))).filter("target = 'clean' OR cdc_row_kind <> '-D'")
    current, expected_log = _expected_ids(spark, sf)
    return check(both(rows), found, both(current), log, both(expected_log), by=["target"])


@query
def event_id_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _two_cases(spark, sf, reconcile.event_id_audit)


@query
def reconcile_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _two_cases(spark, sf, reconcile.reconcile_summary)


@query
def uniqueness(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the unique columns that occur more than once."""
    return reconcile.repeated_keys(
        damage(orders_current(spark, sf)), ["order_id", "business_key", "event_id"]
    )


@query
def status_match(spark: SparkSession, sf: str) -> DataFrame:
    """Do keys and states match the expected map, for the right and the damaged table."""
    rows = orders_current(spark, sf)
    clean = reconcile.same_statuses(rows, rows).withColumn("target", F.lit("clean"))
    return clean.unionByName(
        reconcile.same_statuses(damage(rows), rows).withColumn("target", F.lit("damaged"))
    )


@query
def position_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Log positions the table is behind, though rows were deleted at the source."""
    log = _batched(spark, sf)
    return reconcile.position_lag(log, log.filter(F.col("batch_id") <= VERSION))


# -- scenarios ---------------------------------------------------------------------------


def _scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """One scripted run per order; its state decides the script."""
    kind = F.when(F.col("o_orderstatus") == "F", "smoke").when(F.col("o_orderstatus") == "O", "crash")
    return _orders(spark, sf).select(
        F.col("o_orderkey").alias("scenario_id"),
        kind.otherwise("restore").alias("kind"),
        F.col("o_orderpriority").alias("priority"),
    )


@query
def scenario_final(spark: SparkSession, sf: str) -> DataFrame:
    """Final rows of every scripted run."""
    return state.current_state(D.decode_upserts(feeds.scenario_feed(_scenarios(spark, sf))))


RUN = ["scenario_id", "kind", "priority"]


def _scenario_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Final rows and change rows of all scripted runs, with damage by priority: a lost row, a doubled
    change, a kept key. Labels travel with the envelopes, so nothing is joined back.
    """
    feed = feeds.scenario_feed(_scenarios(spark, sf), RUN)
    log, priority = D.decode(feed, keep=RUN), F.col("priority")
    gone = F.col("cdc_row_kind") == "-D"
    # A key's newest change travels with what the audits read of it, not with its whole row.
    narrow = log.select(*RUN, "order_id", "event_id", "cdc_row_kind", *POSITION_COLUMNS, "_img")
    target = state.latest_by_key(narrow, keep_deletes=True).filter(~gone)
    lost = (priority == "1-URGENT") & (F.col("order_id") % feeds.SCENARIO_STRIDE == 2)
    one = F.lit(1).cast("bigint")
    return (
        target.filter(~lost).select(*RUN, "order_id", "event_id", one.alias("target"), (one - 1).alias("log")),
        log.select(
            *RUN, "order_id", "event_id",
            F.when(gone & (priority == "5-LOW"), 1).otherwise(0).cast("bigint").alias("target"),
            F.when(gone & (priority == "2-HIGH"), 2).otherwise(1).cast("bigint").alias("log"),
        ),
    )


def _scenario_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that each run should end with and log, from literal lists, one scan for both."""

    def listed(kind: str) -> Column:
        # One row an id: how often each list names it is counted here, not in a shuffle.
        final, logged = Counter(FINAL_IDS[kind]), Counter(LOG_IDS[kind])
        entry = lambda n: F.struct(
            (F.col("scenario_id") * feeds.SCENARIO_STRIDE + n).alias("event_id"),
            F.lit(final[n]).cast("bigint").alias("expected"), F.lit(logged[n]).cast("bigint").alias("expected_log"),
        )
        return F.when(F.col("kind") == kind, F.array(*[entry(n) for n in sorted({*final, *logged})]))

    return _scenarios(spark, sf).select(*RUN, F.inline(F.coalesce(*[listed(kind) for kind in FINAL_IDS])))


FINAL_IDS = {"smoke": [1002], "crash": [3, 4, 1002], "restore": [3, 4, 1002]}
LOG_IDS = {
    "smoke": [1, 2, 1, 1001, 2, 1002, 1001],
    "crash": [1, 2, 3, 4, 1, 1001, 2, 1002, 1001],
    "restore": [1, 2, 3, 4, 1, 1001, 2, 1002, 1001],
}


@query
def scenario_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Audits of all scripted runs rolled up by script and priority."""
    zero = F.lit(0).cast("bigint")
    target, log = _scenario_rows(spark, sf)
    found = target.unionByName(log).select(
        *RUN, "event_id", zero.alias("source"), "target", zero.alias("expected"), "log", zero.alias("expected_log")
    )
    wanted = _scenario_ids(spark, sf).select(
        *RUN, "event_id", F.col("expected").alias("source"), zero.alias("target"), "expected", zero.alias("log"), "expected_log"
    )
    results = reconcile.scenario_audit(found.unionByName(wanted), RUN)
    timed_out = (F.col("kind") == "crash") & (F.col("priority") == "3-MEDIUM")
    results = results.withColumnRenamed("id_diff_count", "snapshot_diff_count").withColumn(
        "error", F.when(timed_out, "timed out")
    )
    return reconcile.scenario_summary(results, ["kind", "priority"])


@query
def smoke_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted key absent, updated key current, changelog long enough: runs that pass, by priority."""
    target, log = _scenario_rows(spark, sf)
    n = F.col("order_id") - F.col("scenario_id") * feeds.SCENARIO_STRIDE
    event = F.col("event_id") - F.col("scenario_id") * feeds.SCENARIO_STRIDE
    least = F.when(F.col("kind") == "smoke", 7).otherwise(9)
    runs = reconcile.smoke_checks(target.unionByName(log), RUN, n == 1, (n == 2) & (event == 1002), least)
    return runs.groupBy("kind", "priority").agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.count_if(c).alias(c) for c in ("deleted_key_absent", "updated_key_current", "changelog_long_enough")],
    )


# -- run metrics -------------------------------------------------------------------------

HOUR = 3_600_000_000


def _hour(ts: Column) -> Column:
    return S.micros_to_timestamp(S.floor_div(S.epoch_micros(ts), HOUR) * HOUR)


def _lag_series(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly lag per event type; what arrives from 8 to 12 is committed at 14."""
    e = _events(spark, sf).select(
        F.col("event_type").alias("job"), "event_id", _hour(F.col("ts")).alias("bucket")
    )
    hour = F.hour("bucket")
    late = S.add_seconds(F.col("bucket"), (F.lit(14) - hour) * 3600)
    done = e.withColumn("bucket", F.when((hour >= 8) & (hour < 12), late).otherwise(F.col("bucket")))
    return runmetrics.lag_series(e, done, "job", "bucket", "event_id")


@query
def commit_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and ids the table is behind its source at the end of each hour."""
    return _lag_series(spark, sf)


@query
def commit_lag_total(spark: SparkSession, sf: str) -> DataFrame:
    """The same measure at one moment, per event type and for everything."""
    e = _events(spark, sf)
    done = e.filter(F.col("ts") < F.expr("TIMESTAMP_NTZ'2024-01-16 00:00:00'"))
    per = reconcile.commit_lag(e, done, by=["event_type"])
    return per.unionByName(reconcile.commit_lag(e, done).withColumn("event_type", F.lit("all")))


@query
def lag_phases(spark: SparkSession, sf: str) -> DataFrame:
    """Each hourly sample with its number, phase and time since the first."""
    return runmetrics.label_phases(_lag_series(spark, sf), 3).select(
        "job", "bucket", "sample_index", "elapsed_ms", "phase", "lag_events"
    )


@query
def recovery_streak(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of samples without lag."""
    rows = runmetrics.recovery_streak(_lag_series(spark, sf))
    return rows.select("job", "bucket", "lag_events", "streak", "stops_here")


@query
def interval_max(spark: SparkSession, sf: str) -> DataFrame:
    """Largest value since the sample before, for samples half an hour after busy hours."""
    e = _events(spark, sf).select(F.col("event_type").alias("job"), "ts", "value")
    hour = _hour(F.col("ts"))
    samples = e.select("job", S.add_seconds(hour, F.lit(5400)).alias("ts")).distinct()
    return runmetrics.interval_max(samples, e, "value")


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Baseline against load for every event type."""
    s = runmetrics.label_phases(_lag_series(spark, sf), 3)
    lag, i = F.col("lag_events"), F.col("sample_index")
    samples = s.select(
        "job",
        "sample_index",
        "phase",
        (lag * 3 + i % 5 + 20).cast("double").alias("duration_ms"),
        F.when(i != 1, lag / 4.0).alias("alignment_time_ms"),
        F.floor(i / 100).cast("double").alias("failed_count"),
        S.pressure_indicator(
            F.when(i % 2 == 0, (lag * 8).cast("double")),
            F.lit(None).cast("double"),
            F.when(i % 3 > 0, (lag * 16).cast("double")),
        ).alias("indicator"),
        F.when(i % 7 != 6, lag).alias("lag_events"),
    )
    return runmetrics.run_summary(samples, ["job"])


@query
def pressure_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The pressure indicator over every mix of present and absent signals."""
    e = _events(spark, sf)
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    explicit = F.when(kind == "click", 0.0).when(kind != "view", F.col("value") * 10)
    flag = F.when(kind == "error", 1.0).when(kind != "signup", 0.0)
    busy = F.when(k % 3 != 0, k * 12.0)
    return e.select(
        "event_id",
        explicit.alias("explicit"),
        F.when(k % 5 != 0, flag).alias("flag"),
        busy.alias("busy"),
    ).select("*", S.pressure_indicator(F.col("explicit"), F.col("flag"), F.col("busy")).alias("indicator"))


def _metric_text(spark: SparkSession, sf: str) -> DataFrame:
    """One reporter line per event, some of them comments or noise."""
    e = _events(spark, sf)
    kind = F.col("event_type")
    cents = F.round(F.col("value") * 100).cast("bigint")
    name = (
        F.when(kind == "click", "engine_job_lastCheckpointDuration")
        .when(kind == "purchase", "engine_task_checkpointAlignmentTime")
        .when(kind == "signup", "engine_task_busyTimeMsPerSecond")
        .otherwise("engine_task_backPressuredTimeMsPerSecond")
    )
    labels = F.format_string('{job_id="job-%d",event="%d"}', F.col("user_id") % 3, "event_id")
    line = F.concat(name, F.when(kind == "view", F.lit("")).otherwise(labels), F.lit(" "), cents, F.lit(".5"))
    line = F.when(kind == "error", F.concat(F.lit("  # HELP "), F.col("event_id"))).otherwise(line)
    return e.select("event_id", line.alias("value"))


@query
def metric_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Reporter text to names, labels and values."""
    m = runmetrics.metric_lines(_metric_text(spark, sf))
    label = lambda k: F.try_element_at("labels", F.lit(k))
    return m.select(
        "event_id", "name", label("job_id").alias("job_id"), label("event").alias("event"), "value"
    )


@query
def metric_max(spark: SparkSession, sf: str) -> DataFrame:
    """Largest value of each quantity for one job; lines without a job count for every job."""
    metrics = runmetrics.job_metrics(runmetrics.metric_lines(_metric_text(spark, sf)), "job-1")
    snap = runmetrics.reporter_snapshot(metrics)
    return snap.select(
        "checkpoint_duration_ms",
        "checkpoint_duration_ms_name",
        "checkpoint_alignment_time_ms",
        "checkpoint_failed_count",
        "backpressured_time_ms_per_second",
        "busy_time_ms_per_second",
        "pressure_indicator",
    )


@query
def json_path_max(spark: SparkSession, sf: str) -> DataFrame:
    """Largest number below matching paths of nested JSON."""
    e = _events(spark, sf)
    c = F.round(F.col("value") * 100).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.format_string(
        '{"id": %d, "props": %s, "tasks": [{"subtasks": [{"alignment": {"duration": %d, "buffered": %d}},'
        ' {"alignment": {"duration": %d}}], "start_delay": %d}], "alignment_duration": "12", "ok": true}',
        "event_id", "props", c, k, c + 1, k,
    )
    numbers = e.select("event_id", doc.alias("doc")).select("event_id", S.json_numbers(F.col("doc")).alias("numbers"))
    wanted = {"alignment": (["alignment"], ["duration"]), "delay": (["start", "delay"], [])}
    return numbers.select("event_id", *runmetrics.path_maxima("numbers", wanted)).unpivot(
        "event_id", list(wanted), "what", "max_number"
    )


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One status document per event: a latest checkpoint (not after errors) and a short history."""
    e = _events(spark, sf)
    c = F.round(F.col("value") * 100).cast("double")

    def entry(i: Column, s: str, d: Column) -> Column:
        path = F.when(i % 4 != 0, F.concat(F.lit("chk-"), i))
        return F.struct(i.alias("id"), F.lit(s).alias("status"), d.alias("end_to_end_duration"), path.alias("external_path"))

    n = F.col("event_id")
    latest = F.when(F.col("event_type") != "error", entry(n, "COMPLETED", c))
    doc = F.to_json(
        F.struct(
            F.struct(F.lit(1.0).alias("failed")).alias("counts"),
            F.struct(latest.alias("completed")).alias("latest"),
            F.array(
                entry(n, "COMPLETED", c + 5), entry(n - 1, "COMPLETED", c + 1), entry(n - 2, "FAILED", c)
            ).alias("history"),
        )
    )
    return e.select("event_id", doc.alias("doc"))


@query
def checkpoint_history(spark: SparkSession, sf: str) -> DataFrame:
    """Completed checkpoints of every status document, each once."""
    return runmetrics.completed_checkpoints(_payloads(spark, sf), "doc", ["event_id"])


@query
def latest_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """The latest completed checkpoint of every status document."""
    return runmetrics.latest_completed(_payloads(spark, sf), "doc", ["event_id"])


@query
def restorable_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    """The newest checkpoint of every status document that has a path."""
    return runmetrics.latest_restorable(_payloads(spark, sf), "doc", ["event_id"])


@query
def checkpoint_record(spark: SparkSession, sf: str) -> DataFrame:
    """Full checkpoint records: details before the latest entry, nested numbers, sizes."""
    c = F.round(F.col("value") * 100).cast("bigint")
    n, kind = F.col("event_id"), F.col("event_type")
    latest = F.format_string(
        '{"id": %d, "status": "COMPLETED", "trigger_timestamp": %d, "latest_ack_timestamp": %d,'
        ' "end_to_end_duration": %d, "alignment_buffered": "7", "checkpointed_size": %d}',
        n, n * 1000, n * 1000 + c, c, c * 2,
    )
    details = F.format_string(
        '{"end_to_end_duration": %d, "tasks": {"t1": {"alignment": {"duration": %d, "buffered": 3}, "start_delay": %d}}}',
        c + 1, n, n + 1,
    )
    rows = _events(spark, sf).select(
        "event_id", latest.alias("latest"), F.when(kind == "view", details).when(kind == "click", F.lit("{}")).alias("details")
    )
    return runmetrics.checkpoint_records(rows, "latest", "details", ["event_id"])


@query
def first_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Repeated ids, the first kept."""
    e = _events(spark, sf).select("user_id", "event_type", "event_id", "value", "ts")
    return runmetrics.first_per_id(e, ["user_id", "event_type"], "event_id")


# -- layout ------------------------------------------------------------------------------


def _doc_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.table(spark, sf, "documents").select("source", "lang", F.col("n_chars").alias("length"))


@query
def size_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Size distribution per source, documents standing for files."""
    return maintain.size_stats(_doc_sizes(spark, sf), by=("source",))


@query
def timing_median(spark: SparkSession, sf: str) -> DataFrame:
    """Median timing in milliseconds per language."""
    t = _doc_sizes(spark, sf).withColumn("ns", F.col("length") * 1_234_567)
    return maintain.median_ms(t, "ns", by=("lang",))


@query
def layout_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Before and after merging each source's documents per language."""
    files = _doc_sizes(spark, sf)
    merged = files.groupBy("source", "lang").agg(F.sum("length").alias("length"))

    def layout(df: DataFrame) -> DataFrame:
        stats = maintain.size_stats(df, by=("source",))
        n = F.col("data_file_count")
        return stats.select(
            "source",
            "data_file_count",
            F.least(n, F.lit(4)).alias("commit_count"),
            "median_file_size_bytes",
            (n * 0.5).alias("planning_latency_ms"),
        )

    return maintain.layout_deltas(layout(files), layout(merged), "source")


# -- generators and text -----------------------------------------------------------------


@query
def gen_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """Arithmetic orders, one per order key."""
    return feeds.sequence_orders(
        _orders(spark, sf),
        "o_orderkey",
        base_event_id=2_000_000,
        prefix="order-",
        customer_base=10_000,
        amount_base=25_000,
        seed=222,
    )


@query
def gen_seeded(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded orders numbered by the keys of the table."""
    return feeds.seeded_rows(_orders(spark, sf), "o_orderkey", seed=1)


@query
def tsv_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the keyed table as tab-joined lines, nulls written out."""
    rows = orders_current(spark, sf).withColumn(
        "customer_id", F.when(F.col("status") != "paid", F.col("customer_id"))
    )
    return sqlapi.tsv(rows)


@query
def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of whole documents without blank and noise lines."""
    d = feeds.table(spark, sf, "documents")
    src = F.col("source")
    mark = (
        F.when(src == "src1", "SLF4J: ").when(src == "src2", "WARNING:").when(src == "src3", "log4j:WARN ").otherwise("")
    )
    lines = d.select("doc_id", mark.alias("m"), F.posexplode(F.split("text", "\n")).alias("line_no", "t"))
    lines = lines.select("doc_id", "line_no", F.concat("m", "t").alias("value"))
    return sqlapi.clean_lines(lines)


# -- evidence ----------------------------------------------------------------------------


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """One evidence document per order, with faults by priority and state."""
    o = _orders(spark, sf)
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    rec = F.when(st == "F", evidence.RECONCILIATION).when(st == "O", evidence.REWRITE).otherwise("other")
    unless = lambda cond, c: F.when(~cond, c)
    stack = F.when(pr == "2-HIGH", F.lit('"none"')).otherwise(F.lit('{"spark": "4"}'))
    number = F.when(pr == "3-MEDIUM", F.lit('"2"')).otherwise(F.col("o_custkey").cast("string"))
    result = F.format_string(
        '{"failure_class": "c%d", "snapshot_diff_count": %s, "snapshot_diff": {}}', F.col("o_orderkey") % 3, number
    )
    results = F.when(pr == "4-NOT SPECIFIED", F.lit("[]")).otherwise(F.concat(F.lit("["), result, F.lit(", "), result, F.lit("]")))
    started = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    finished = F.date_format(S.add_seconds(F.col("o_orderdate"), F.col("o_custkey")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    good = F.when(pr == "3-MEDIUM", '"true"').when(pr == "2-HIGH", "false").otherwise("true")
    rewrite = F.format_string(
        ', "before": {}, "after": {}, "rewrite_data_files": {}, "summary": {"passed": %s}, "checks": '
        '{"data_file_count_decreased": true, "commit_count_decreased": %s, '
        '"median_file_size_increased": true, "planning_latency_decreased": true}',
        good, good,
    )
    doc = F.concat(
        F.lit('{"run_id": "r'), F.col("o_orderkey"), F.lit('"'),
        F.coalesce(unless(pr == "1-URGENT", F.lit(', "git_sha": "abc"')), F.lit("")),
        F.lit(', "started_at": "'), started, F.lit('", "finished_at": "'), finished,
        F.lit('", "command": "run", "logs": "l.log", "stack_versions": '), stack,
        F.when(st == "F", F.concat(F.lit(', "results": '), results)).otherwise(F.lit("")),
        F.when((st == "O") & (pr != "5-LOW"), rewrite).otherwise(F.lit("")),
        F.lit("}"),
    )
    return o.select(
        F.concat(F.lit("r"), F.col("o_orderkey"), F.lit(".json")).alias("file_name"), rec.alias("kind"), doc.alias("doc")
    )


@query
def contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Broken rules of every evidence document."""
    return evidence.contract_violations(_records(spark, sf))


@query
def artifact_index(spark: SparkSession, sf: str) -> DataFrame:
    """One index line per evidence document."""
    return evidence.record_index(_records(spark, sf))


@query
def evidence_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Diff counts per document and failure class."""
    return evidence.evidence_rollup(_records(spark, sf))


# -- plain SQL ---------------------------------------------------------------------------

for _name, _text in conformance.STATEMENTS.items():

    def _run(spark: SparkSession, sf: str, text: str = _text) -> DataFrame:
        for name in conformance.TABLES:
            feeds.table(spark, sf, name).createOrReplaceTempView(name)
        return sqlapi.sql(spark, text)

    QUERIES[_name] = _run


@query
def sql_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Every purchase with the user's last view before it."""
    e = _events(spark, sf).select("user_id", "event_id", "event_type", "value")
    seen = previous_row(
        e, "user_id", "event_id", ["event_id", "value"], "seen", where=F.col("event_type") == "view"
    )
    return seen.filter("event_type = 'purchase'").select(
        "event_id",
        "user_id",
        F.col("seen.event_id").alias("view_id"),
        F.col("seen.value").alias("view_value"),
    )


# -- text forms, readings, round trips -----------------------------------------------------


@query
def text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Whole numbers from text: plain, with a fraction, too large, no number, negative."""
    key = F.col("o_custkey").cast("string")
    pr = F.col("o_orderpriority")
    text = (
        F.when(pr == "1-URGENT", key)
        .when(pr == "2-HIGH", F.concat(key, F.lit(".7")))
        .when(pr == "3-MEDIUM", F.concat(F.lit("99999999"), key))
        .when(pr == "4-NOT SPECIFIED", F.concat(F.lit("x"), key))
        .otherwise(F.concat(F.lit("-"), key))
    )
    o = _orders(spark, sf).select("o_orderkey", text.alias("text"))
    dtype = o.schema["text"].dataType
    return o.select(
        "o_orderkey",
        S.coerce_whole(F.col("text"), dtype, "int").alias("as_int"),
        S.coerce_whole(F.col("text"), dtype, "bigint").alias("as_bigint"),
    )


@query
def output_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The last JSON object of a job's output, and whole numbers from its summary map."""
    o = _orders(spark, sf)
    key, out = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    text = (
        F.when(out == "O", F.concat(F.lit('start\n{"id": 0}\n  {"id": '), key, F.lit("}\nend")))
        .when(out == "F", F.concat(F.lit('done {"id": '), key, F.lit("} after")))
        .otherwise(F.lit("nothing here"))
    )
    summary = F.create_map(F.lit("rows"), F.when(out == "O", key).otherwise(F.concat(F.lit("n"), key)))
    return o.select(
        "o_orderkey",
        S.last_json_object(text).alias("doc"),
        S.summary_int(summary, "rows").alias("row_count"),
        S.summary_int(summary, "files").alias("file_count"),
    )


@query
def merged_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Several readings of a quantity to one: the first that is there, and the largest."""
    e = _events(spark, sf).select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 1, "n/a").alias("a"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("b"),
    )
    first = runmetrics.merged_sample({"first_reading": ["a", "b"]}, "first")
    most = runmetrics.merged_sample({"largest_reading": ["a", "b"]}, "max")
    return e.select("event_id", *first.values(), *most.values())


@query
def tsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as tab-separated lines and read back with their types."""
    rows = orders_current(spark, sf).select(
        "order_id", "business_key", F.when(F.col("status") != "paid", F.col("status")).alias("status"), "amount_cents"
    )
    path = run_dir(spark, "tsv")
    sqlapi.write_tsv(rows, path)
    return sqlapi.read_tsv(spark, path, "order_id bigint, business_key string, status string, amount_cents bigint")
