"""Declared schemas, as Spark DDL. Streams never infer."""

from __future__ import annotations

ORDER_FIELDS = (
    ("order_id", "bigint"),
    ("business_key", "string"),
    ("event_id", "bigint"),
    ("customer_id", "bigint"),
    ("status", "string"),
    ("amount_cents", "bigint"),
    ("updated_at", "timestamp_ntz"),
    ("seed", "int"),
)
CURRENT_COLUMNS = [name for name, _ in ORDER_FIELDS]
CHANGELOG_COLUMNS = [*CURRENT_COLUMNS, "cdc_row_kind", "cdc_operation", "source_ts_ms"]
#: Where a change stands in its log: number of the log file, offset in it, row of the event.
POSITION_COLUMNS = ["_file", "_seq", "_row"]
CHANGE_COLUMNS = [*CHANGELOG_COLUMNS, *POSITION_COLUMNS, "_img"]

CURRENT = ", ".join(f"{name} {kind}" for name, kind in ORDER_FIELDS)
CHANGELOG = f"{CURRENT}, cdc_row_kind string, cdc_operation string, source_ts_ms bigint"
CHANGE = f"{CHANGELOG}, _file bigint, _seq bigint, _row int, _img tinyint"
STORED_CHANGE = f"{CHANGE}, writer_id string, batch_id bigint"

_POSITION = "struct<file: string, pos: bigint, row: int>"


def _envelope(image: str) -> str:
    return (
        f"op string, ts_ms bigint, before struct<{image}>, after struct<{image}>, "
        f"source {_POSITION}, _corrupt_record string"
    )


#: Envelopes as a log delivers them: numbers are numbers, times are numbers or text. A field of
#: another type reads as null and the record is kept whole in ``_corrupt_record``.
ENVELOPE = _envelope(
    ", ".join(f"{n}: {'string' if k == 'timestamp_ntz' else k}" for n, k in ORDER_FIELDS)
)
#: The same with every field as text, for writers that quote or carry fractions.
TEXT_ENVELOPE = _envelope(", ".join(f"{name}: string" for name, _ in ORDER_FIELDS))

STORED_REJECT = (
    "reject_reason string, op string, _file bigint, _seq bigint, _row int, raw string, writer_id string, batch_id bigint"
)
COMMIT = (
    "batch_id bigint, rows bigint, rejects bigint, min_file bigint, min_seq bigint, max_file bigint, max_seq bigint, "
    "committed_at timestamp, writer_id string, block bigint"
)
COVERAGE = "writer_id string, batch_id bigint"
SNAPSHOT_LOG = "snapshot_id bigint, rows bigint, created_at timestamp"
DATA_FILE = "path string, length bigint"
PROGRESS = (
    "run_id string, batch_id bigint, at string, input_rows bigint, input_rows_per_second double, "
    "trigger_ms bigint, add_batch_ms bigint, wal_commit_ms bigint, commit_offsets_ms bigint"
)

#: One status sample of a run, as the summary expects it.
SAMPLE = """
    sample_index int, phase string, collected_at string, elapsed_ms bigint,
    checkpoint struct<latest_completed_id: bigint, duration_ms: double, alignment_time_ms: double,
        alignment_buffered_bytes: double, start_delay_ms: double, failed_count: double,
        reporter_metric_names: map<string, string>>,
    backpressure struct<indicator: double, backpressured_time_ms_per_second: double,
        is_backpressured: double, busy_time_ms_per_second: double, metric_names: map<string, string>>,
    commit_lag struct<source_max_event_id: bigint, table_max_event_id: bigint, max_event_id_gap: bigint,
        source_rows: bigint, changelog_rows: bigint, lag_events: bigint>
"""

CHECKPOINTS = """
    counts struct<failed: double>,
    latest struct<completed: struct<id: bigint, status: string, end_to_end_duration: double, external_path: string>>,
    history array<struct<id: bigint, status: string, end_to_end_duration: double, external_path: string>>
"""
