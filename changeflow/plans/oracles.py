"""SQL counterparts of the registered queries, written from the rules rather than from the plans.

Where the Spark side takes a maximum, these ask that nothing newer exists, and so on, so that a
mistake would have to be made twice in different words to stay hidden.
"""

from __future__ import annotations

from changeflow.plans import conformance
from changeflow.sources import feeds

_ORD_IMG = """
ord_img AS (
    SELECT o.o_orderkey AS k, o.o_orderstatus AS st, v.i,
           o.o_orderkey AS order_id,
           'order-' || lpad(CAST(o.o_orderkey AS VARCHAR), 12, '0') AS business_key,
           o.o_orderkey * 4 + v.i AS event_id,
           o.o_custkey AS customer_id,
           v.status,
           CAST(round(o.o_totalprice * 100) AS BIGINT) + 100 * v.i AS amount_cents,
           o.o_orderdate + to_seconds(v.i) AS updated_at,
           42 AS seed,
           epoch_ms(o.o_orderdate) + 250 AS ms
    FROM orders o
    CROSS JOIN (VALUES (0, 'created'), (1, 'paid'), (2, 'packed')) v(i, status)
    WHERE v.i = 0 OR (v.i = 1 AND o.o_orderstatus <> 'O') OR (v.i = 2 AND o.o_orderstatus = 'P')
)"""

_COLS = "order_id, business_key, event_id, customer_id, status, amount_cents, updated_at, seed"

_ORD_LOG = f"""{_ORD_IMG},
ord_log AS (
    SELECT {_COLS}, '+I' AS cdc_row_kind, 'insert' AS cdc_operation, ms AS source_ts_ms,
           k * 4 AS _seq, CAST(1 AS TINYINT) AS _img
    FROM ord_img WHERE i = 0
    UNION ALL
    SELECT {_COLS}, '-U', 'update_before', ms + 1000 * (i + 1), k * 4 + i + 1, CAST(0 AS TINYINT)
    FROM ord_img WHERE (st = 'F' AND i = 0) OR (st = 'P' AND i < 2)
    UNION ALL
    SELECT {_COLS}, '+U', 'update_after', ms + 1000 * i, k * 4 + i, CAST(1 AS TINYINT)
    FROM ord_img WHERE i > 0
    UNION ALL
    SELECT {_COLS}, '-D', 'delete', ms + 3000, k * 4 + 3, CAST(0 AS TINYINT)
    FROM ord_img WHERE st = 'P' AND i = 2 AND k % 3 = 0
)"""

_EV_LOG = f"""
ev AS (
    SELECT event_id, user_id AS order_id,
           'user-' || lpad(CAST(user_id AS VARCHAR), 12, '0') AS business_key,
           user_id AS customer_id, event_type AS status,
           CAST(round(value * 100) AS BIGINT) AS amount_cents,
           ts AS updated_at, 7 AS seed, epoch_us(ts) // 1000 AS source_ts_ms,
           lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_id,
           lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_type
    FROM events
),
ev_log AS (
    SELECT {_COLS}, '+I' AS cdc_row_kind, 'insert' AS cdc_operation, source_ts_ms,
           event_id AS _seq, CAST(1 AS TINYINT) AS _img
    FROM ev WHERE status <> 'error' AND (prev_id IS NULL OR prev_type = 'error')
    UNION ALL
    SELECT {_COLS}, '+U', 'update_after', source_ts_ms, event_id, CAST(1 AS TINYINT)
    FROM ev WHERE status <> 'error' AND prev_type <> 'error'
    UNION ALL
    SELECT p.order_id, p.business_key, p.event_id, p.customer_id, p.status, p.amount_cents,
           p.updated_at, p.seed,
           CASE WHEN e.status = 'error' THEN '-D' ELSE '-U' END,
           CASE WHEN e.status = 'error' THEN 'delete' ELSE 'update_before' END,
           e.source_ts_ms, e.event_id, CAST(0 AS TINYINT)
    FROM ev e JOIN ev p ON p.event_id = e.prev_id WHERE p.status <> 'error'
)"""


def _current(log: str, where: str = "TRUE", columns: str = _COLS) -> str:
    return f"""SELECT {columns} FROM {log} l
        WHERE cdc_row_kind IN ('+I', '+U') AND ({where}) AND NOT EXISTS (
            SELECT 1 FROM {log} m WHERE m.order_id = l.order_id AND m.cdc_row_kind <> '-U'
            AND m._seq > l._seq AND ({where.replace('l.', 'm.')}))"""


_ORD_CUR = f"{_ORD_LOG},\ncur AS ({_current('ord_log')})"

_DAMAGED = f"""{_ORD_CUR},
kept AS (
    SELECT order_id, business_key, event_id, customer_id, status,
           amount_cents + CASE WHEN order_id % 19 = 5 THEN 1 ELSE 0 END AS amount_cents, updated_at, seed
    FROM cur WHERE order_id % 17 <> 3
),
dam AS (
    SELECT {_COLS} FROM kept
    UNION ALL SELECT {_COLS} FROM kept WHERE order_id % 23 = 7
    UNION ALL SELECT -order_id - 1, business_key, -event_id - 1, customer_id, status, amount_cents,
                     updated_at, seed FROM cur WHERE order_id % 29 = 11
)"""

_ORACLE_IDS = """
expected AS (
    SELECT o_orderkey * 4 + CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS event_id
    FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 3 = 0)
)"""


def _audit(target: str, log: str) -> str:
    """Audit columns as scalar sub-queries."""
    match = f"""(NOT EXISTS (SELECT event_id FROM cur EXCEPT SELECT event_id FROM {target})
        AND NOT EXISTS (SELECT event_id FROM {target} EXCEPT SELECT event_id FROM cur)
        AND NOT EXISTS (SELECT event_id FROM cur EXCEPT SELECT event_id FROM expected)
        AND NOT EXISTS (SELECT event_id FROM expected EXCEPT SELECT event_id FROM cur))"""
    logs = f"""(NOT EXISTS (SELECT event_id FROM {log} EXCEPT SELECT event_id FROM ord_log)
        AND NOT EXISTS (SELECT event_id FROM ord_log EXCEPT SELECT event_id FROM {log}))"""
    rows = f"((SELECT count(*) FROM {log}) = (SELECT count(*) FROM ord_log))"
    return f"""
        (SELECT count(DISTINCT event_id) FROM cur) AS source_current_ids,
        (SELECT count(DISTINCT event_id) FROM {target}) AS target_current_ids,
        (SELECT count(DISTINCT event_id) FROM expected) AS expected_current_ids,
        {match} AS current_sets_match,
        (SELECT count(DISTINCT event_id) FROM {log}) AS changelog_distinct_ids,
        (SELECT count(DISTINCT event_id) FROM ord_log) AS expected_changelog_ids,
        {logs} AS changelog_set_match,
        (SELECT count(*) FROM {log}) AS changelog_row_count,
        (SELECT count(*) FROM ord_log) AS expected_changelog_row_count,
        {rows} AS changelog_row_count_match,
        {match} AND {logs} AND {rows} AS consistent"""


_SHORT_LOG = f"{_ORACLE_IDS}, short_log AS (SELECT * FROM ord_log WHERE cdc_row_kind <> '-D')"


def _summary(target: str, log: str, name: str) -> str:
    missing = f"(SELECT count(*) FROM (SELECT {_COLS} FROM cur EXCEPT SELECT {_COLS} FROM {target}) a)"
    unexpected = f"(SELECT count(*) FROM (SELECT {_COLS} FROM {target} EXCEPT SELECT {_COLS} FROM cur) b)"
    multi = f"""(SELECT count(*) FROM (SELECT {_COLS} FROM cur EXCEPT ALL SELECT {_COLS} FROM {target}) c)
        + (SELECT count(*) FROM (SELECT {_COLS} FROM {target} EXCEPT ALL SELECT {_COLS} FROM cur) d)"""
    return f"""SELECT *, snapshot_diff_count = 0 AND consistent AS reconciled FROM (
        SELECT '{name}' AS target,
        (SELECT count(*) FROM cur) AS source_row_count, (SELECT count(*) FROM {target}) AS target_row_count,
        {missing} AS missing_count, {unexpected} AS unexpected_count,
        {missing} + {unexpected} AS snapshot_diff_count, {multi} AS multiset_diff_count,
        {_audit(target, log)}) z"""


_SCEN = """
runs AS (
    SELECT o_orderkey AS sid, o_orderpriority AS priority,
           CASE o_orderstatus WHEN 'F' THEN 'smoke' WHEN 'O' THEN 'crash' ELSE 'restore' END AS kind
    FROM orders
)"""

# (kind, id within the run) of final rows; and of every changelog row with its kind
_SCEN_FINAL = """(VALUES ('smoke', 2, 1002), ('crash', 3, 3), ('crash', 4, 4), ('crash', 2, 1002),
    ('restore', 3, 3), ('restore', 4, 4), ('restore', 2, 1002)) f(kind, n, e)"""

_HOURS = """
arr AS (SELECT event_type AS job, date_trunc('hour', ts) AS bucket, event_id FROM events),
com AS (
    SELECT job, CASE WHEN hour(bucket) BETWEEN 8 AND 11 THEN date_trunc('day', bucket) + INTERVAL 14 HOUR
                     ELSE bucket END AS bucket, event_id FROM arr
),
steps AS (SELECT job, bucket FROM arr UNION SELECT job, bucket FROM com),
a AS (SELECT job, bucket, count(*) AS n, max(event_id) AS m FROM arr GROUP BY ALL),
c AS (SELECT job, bucket, count(*) AS n, max(event_id) AS m FROM com GROUP BY ALL),
lag AS (
    SELECT s.job, s.bucket,
        (SELECT coalesce(max(m), 0) FROM a WHERE a.job = s.job AND a.bucket <= s.bucket) AS source_max_event_id,
        (SELECT coalesce(max(m), 0) FROM c WHERE c.job = s.job AND c.bucket <= s.bucket) AS table_max_event_id,
        (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM a WHERE a.job = s.job AND a.bucket <= s.bucket) AS source_rows,
        (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM c WHERE c.job = s.job AND c.bucket <= s.bucket) AS changelog_rows
    FROM steps s
),
series AS (
    SELECT job, bucket, source_max_event_id, table_max_event_id,
           greatest(source_max_event_id - table_max_event_id, 0) AS max_event_id_gap,
           source_rows, changelog_rows, greatest(source_rows - changelog_rows, 0) AS lag_events
    FROM lag
)"""

_PHASES = f"""{_HOURS},
numbered AS (
    SELECT s.*, CAST((SELECT count(*) FROM series t WHERE t.job = s.job AND t.bucket < s.bucket) AS INTEGER)
           AS sample_index,
           (SELECT min(bucket) FROM series t WHERE t.job = s.job) AS first_bucket
    FROM series s
),
phases AS (
    SELECT *, date_diff('millisecond', first_bucket, bucket) AS elapsed_ms,
           CASE WHEN sample_index < 3 THEN 'baseline' WHEN lag_events > 0 THEN 'backpressure'
                ELSE 'recovery' END AS phase
    FROM numbered
)"""

_CASCADE = """CASE
    WHEN explicit IS NOT NULL AND least(greatest(explicit / 1000.0, 0), 1) > 0
        THEN least(greatest(explicit / 1000.0, 0), 1)
    WHEN flag IS NOT NULL AND flag > 0 THEN least(flag, 1.0)
    WHEN busy IS NOT NULL THEN least(greatest(busy / 1000.0, 0), 1)
    WHEN explicit IS NOT NULL OR flag IS NOT NULL THEN 0.0 END"""

_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_CENTS = "CAST(round(value * 100) AS BIGINT)"

_METRICS = f"""
m AS (
    SELECT event_id, {_CENTS} + 0.5 AS v, event_type,
           CASE event_type WHEN 'click' THEN 'engine_job_lastCheckpointDuration'
                WHEN 'purchase' THEN 'engine_task_checkpointAlignmentTime'
                WHEN 'signup' THEN 'engine_task_busyTimeMsPerSecond'
                ELSE 'engine_task_backPressuredTimeMsPerSecond' END AS name,
           CASE WHEN event_type <> 'view' THEN 'job-' || (user_id % 3) END AS job_id,
           CASE WHEN event_type <> 'view' THEN CAST(event_id AS VARCHAR) END AS event
    FROM events WHERE event_type <> 'error'
)"""


def _stats(rel: str) -> str:
    return f"""SELECT source, CAST(count(*) AS INTEGER) AS data_file_count,
        CAST(sum(length) AS BIGINT) AS total_data_file_size_bytes,
        CAST(median(length) AS DOUBLE) AS median_file_size_bytes,
        CAST(min(length) AS BIGINT) AS min_file_size_bytes, CAST(max(length) AS BIGINT) AS max_file_size_bytes
        FROM {rel} GROUP BY source"""


_SIZES = "sizes AS (SELECT source, lang, n_chars AS length FROM documents)"

_OBJ = "('before'), ('after'), ('rewrite_data_files'), ('checks'), ('summary')"
_CHK = (
    "('data_file_count_decreased'), ('commit_count_decreased'), "
    "('median_file_size_increased'), ('planning_latency_decreased')"
)

_BAD_KEY = "(k % 97 = 0)"

ORACLES: dict[str, str] = {
    "decode_changes": f"WITH {_EV_LOG} SELECT *, CAST(0 AS BIGINT) AS _file, CAST(0 AS INTEGER) AS _row FROM ev_log",
    "changelog_rows": f"WITH {_ORD_LOG} SELECT {_COLS}, cdc_row_kind, cdc_operation, source_ts_ms FROM ord_log",
    "changelog_counts": f"""WITH {_ORD_LOG}, {_EV_LOG}
        SELECT feed, cdc_row_kind, cdc_operation, count(*) AS row_count,
               count(DISTINCT event_id) AS distinct_event_ids, CAST(sum(amount_cents) AS BIGINT) AS amount_cents
        FROM (SELECT 'orders' AS feed, * FROM ord_log UNION ALL SELECT 'events' AS feed, * FROM ev_log) z
        GROUP BY feed, cdc_row_kind, cdc_operation""",
    "decode_rejects": """
        WITH steps AS (
            SELECT o_orderkey AS k, v.i, o_orderkey * 4 + v.i AS _seq,
                   CASE v.i WHEN 0 THEN 'c' WHEN 3 THEN 'd' ELSE 'u' END AS op
            FROM orders CROSS JOIN (VALUES (0), (1), (2), (3)) v(i)
            WHERE v.i = 0 OR (v.i = 1 AND o_orderstatus <> 'O') OR (v.i = 2 AND o_orderstatus = 'P')
               OR (v.i = 3 AND o_orderstatus = 'P' AND o_orderkey % 3 = 0)
        )
        SELECT 'unsupported operation x' AS reject_reason, 'x' AS op, _seq FROM steps WHERE k % 101 = 0
        UNION ALL
        SELECT CASE WHEN op = 'c' THEN 'missing after image' ELSE 'missing before image' END, op, _seq
        FROM steps WHERE k % 97 = 0 AND k % 101 <> 0 AND k % 103 <> 0""",
    "decode_survivors": f"""WITH {_ORD_LOG}
        SELECT order_id, event_id, cdc_row_kind, cdc_operation, _seq, _img FROM ord_log
        WHERE NOT (order_id % 97 = 0 OR order_id % 101 = 0 OR order_id % 103 = 0)""",
    "wide_positions": f"""WITH {_ORD_LOG}
        SELECT order_id, event_id, cdc_row_kind, 600000 + _seq % 4 AS log_file,
               5000000000 + (3 - _seq % 4) * 1000 AS log_offset, CAST(5000 + _seq % 4 AS INTEGER) AS log_row
        FROM ord_log l WHERE cdc_row_kind <> '-U' AND NOT EXISTS (
            SELECT 1 FROM ord_log m WHERE m.order_id = l.order_id AND m.cdc_row_kind <> '-U' AND m._seq > l._seq)""",
    "statement_text": f"""WITH {_ORD_LOG}, t0 AS ({_current('ord_log')}),
        hit1 AS (SELECT *, row_number() OVER (ORDER BY order_id) - 1 AS p FROM t0 WHERE order_id % 3 = 0),
        new1 AS (SELECT * REPLACE ('checked' AS status, amount_cents + 1 AS amount_cents) FROM hit1),
        t1 AS (SELECT * FROM t0 WHERE order_id % 3 <> 0 UNION ALL SELECT * EXCLUDE (p) FROM new1),
        hit2 AS (SELECT *, row_number() OVER (ORDER BY order_id) - 1 AS p FROM t1 WHERE status = 'created'
                 AND customer_id IN (SELECT customer_id FROM t1 WHERE status = 'checked')),
        t2 AS (SELECT * FROM t1 WHERE order_id NOT IN (SELECT order_id FROM hit2)),
        hit3 AS (SELECT order_id + 100000000 AS order_id, business_key || '-again' AS business_key, event_id + 1000000000 AS event_id,
                        customer_id, upper(status) AS status, amount_cents * 2 AS amount_cents, updated_at, seed,
                        row_number() OVER (ORDER BY order_id) - 1 AS p
                 FROM t2 WHERE order_id % 5 = 1),
        hit4 AS (SELECT * FROM (VALUES
                    (-1, 'first', -1, 1, 'CREATED', 100, TIMESTAMP '2026-01-01 00:00:00', 7, 1),
                    (-2, 'second', -2, 1, 'CREATED', 200, TIMESTAMP '2026-01-01 00:00:01', 7, 0))
                    v(order_id, business_key, event_id, customer_id, status, amount_cents, updated_at, seed, p)),
        t4 AS (SELECT * FROM t2 UNION ALL SELECT * EXCLUDE (p) FROM hit3 UNION ALL SELECT * EXCLUDE (p) FROM hit4),
        hit5 AS (SELECT *, row_number() OVER (ORDER BY order_id) - 1 AS p FROM t4 WHERE order_id > 100000000 OR order_id < 0),
        t5 AS (SELECT * FROM t4 WHERE NOT (order_id > 100000000 OR order_id < 0)
               UNION ALL SELECT * EXCLUDE (p) REPLACE (lower(status) AS status) FROM hit5),
        hit6 AS (SELECT *, row_number() OVER (ORDER BY order_id) - 1 AS p FROM t5),
        made(statement, cdc_row_kind, position, order_id, event_id, status, amount_cents) AS (
            SELECT 1, '-U', p, order_id, event_id, status, amount_cents FROM hit1
            UNION ALL SELECT 1, '+U', p, order_id, event_id, status, amount_cents FROM new1
            UNION ALL SELECT 2, '-D', p, order_id, event_id, status, amount_cents FROM hit2
            UNION ALL SELECT 3, '+I', p, order_id, event_id, status, amount_cents FROM hit3
            UNION ALL SELECT 4, '+I', p, order_id, event_id, status, amount_cents FROM hit4
            UNION ALL SELECT 5, '-U', p, order_id, event_id, status, amount_cents FROM hit5
            UNION ALL SELECT 5, '+U', p, order_id, event_id, lower(status), amount_cents FROM hit5
            UNION ALL SELECT 6, '-D', p, order_id, event_id, status, amount_cents FROM hit6)
        SELECT CAST(statement AS BIGINT) AS statement, CAST(position AS BIGINT) AS position, cdc_row_kind, CAST(order_id AS BIGINT) AS order_id,
               CAST(event_id AS BIGINT) AS event_id, status, CAST(amount_cents AS BIGINT) AS amount_cents FROM made""",
    "coerce_timestamps": """
        SELECT event_id, date_trunc('millisecond', ts) AS from_millis, ts AS from_micros,
               TIMESTAMP '1970-01-01' - (date_trunc('millisecond', ts) - TIMESTAMP '1970-01-01') AS from_negative,
               ts AS from_text, ts AS from_instant, date_trunc('second', ts) AS from_seconds,
               CAST(NULL AS TIMESTAMP) AS from_unreadable,
               strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ms_text,
               substr(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 1, 21) || '00' AS padded_text
        FROM events""",
    "current_state": f"WITH {_ORD_LOG} {_current('ord_log')}",
    "current_state_events": f"WITH {_EV_LOG} {_current('ev_log')}",
    "current_state_rekeyed": f"""WITH {_ORD_IMG},
        ins AS (SELECT order_id, event_id, amount_cents FROM ord_img WHERE i = 0),
        newest AS (SELECT -order_id - 1 AS order_id, event_id, amount_cents FROM ord_img l
                   WHERE i > 0 AND NOT EXISTS (SELECT 1 FROM ord_img m WHERE m.k = l.k AND m.i > l.i)
                     AND NOT (st = 'P' AND k % 3 = 0))
        SELECT 'reference' AS mode, * FROM ins UNION ALL SELECT 'reference', * FROM newest
        UNION ALL SELECT 'strict', * FROM newest
        UNION ALL SELECT 'strict', order_id, event_id, amount_cents FROM ord_img WHERE i = 0 AND st = 'O'""",
    "out_of_order": f"WITH {_ORD_LOG} {_current('ord_log')}",
    "source_snapshot": f"WITH {_ORD_LOG} {_current('ord_log')} ORDER BY order_id",
    "merge_on_read": f"WITH {_EV_LOG} {_current('ev_log')}",
    "as_of_version": f"WITH {_EV_LOG} {_current('ev_log', 'l.source_ts_ms // 86400000 <= 19737')}",
    "snapshot_plus_tail": f"WITH {_EV_LOG} {_current('ev_log')}",
    "latest_version": """
        SELECT user_id, event_id AS checkpoint_id,
               'file:///state/' || user_id || '/chk-' || event_id AS external_path
        FROM events e WHERE event_type NOT IN ('error', 'view') AND NOT EXISTS (
            SELECT 1 FROM events f WHERE f.user_id = e.user_id AND f.event_id > e.event_id
            AND f.event_type NOT IN ('error', 'view'))""",
    "table_scan": f"""WITH {_ORD_CUR}
        SELECT order_id, business_key, status, amount_cents, updated_at FROM cur WHERE amount_cents >= 20000000""",
    "committed_only": f"""WITH {_ORD_LOG} SELECT {_COLS}, cdc_row_kind, cdc_operation, source_ts_ms
        FROM ord_log WHERE cdc_row_kind = '+I'""",
    "replay_once": f"WITH {_ORD_LOG} SELECT {_COLS}, cdc_row_kind, cdc_operation, source_ts_ms FROM ord_log",
    "compacted_state": f"WITH {_ORD_LOG} {_current('ord_log')}",
    "late_batch_state": f"WITH {_ORD_LOG} {_current('ord_log')}",
    "commit_summary": f"""WITH {_ORD_LOG},
        steps AS (SELECT DISTINCT order_id AS k, _seq, cdc_row_kind = '+I' AS c FROM ord_log),
        -- a garbled operation is no create any more, so it travels in the second batch
        bad AS (SELECT c AND k % 101 <> 0 AS first_batch FROM steps
                WHERE k % 101 = 0 OR (k % 97 = 0 AND k % 103 <> 0)),
        good AS (SELECT * FROM ord_log WHERE NOT (order_id % 97 = 0 OR order_id % 101 = 0 OR order_id % 103 = 0))
        SELECT CAST(2 AS BIGINT) AS commit_count, 'w' AS current_writer_id, CAST(1 AS BIGINT) AS current_batch_id,
               (SELECT count(*) FROM good WHERE cdc_row_kind <> '+I') AS added_rows,
               (SELECT count(*) FROM bad WHERE NOT first_batch) AS added_rejects,
               (SELECT count(*) FROM good) AS total_rows,
               (SELECT count(*) FROM bad) AS total_rejects,
               (SELECT max(_seq) FROM good) AS max_seq""",
    "union_dedup_stream": f"WITH {_ORD_LOG} SELECT {_COLS}, cdc_row_kind, cdc_operation, source_ts_ms FROM ord_log",
    "newest_stream": f"WITH {_ORD_LOG} {_current('ord_log')}",
    "numbered_versions": f"WITH {_ORD_LOG} {_current('ord_log', 'l._seq % 4 < 2')}",
    "progress_history": f"""WITH {_ORD_LOG}
        SELECT CAST(count(DISTINCT _seq) AS BIGINT) AS input_rows, CAST(0 AS BIGINT) AS without_durations, TRUE AS batches_in_a_row FROM ord_log""",
    "bulk_load": f"""WITH {_ORD_CUR}
        SELECT count(*) AS row_count, CAST(sum(amount_cents) AS BIGINT) AS amount_cents, TRUE AS files_bounded, TRUE AS sizes_agree FROM cur""",
    "sorted_diff": f"""WITH {_DAMAGED},
        d AS (SELECT 'missing' AS side, * FROM (SELECT {_COLS} FROM cur EXCEPT SELECT {_COLS} FROM dam) a
              UNION ALL SELECT 'unexpected', * FROM (SELECT {_COLS} FROM dam EXCEPT SELECT {_COLS} FROM cur) b)
        SELECT row_number() OVER (ORDER BY order_id, side) - 1 AS place, side, order_id, event_id, amount_cents FROM d""",
    "table_reset": f"""WITH {_ORD_CUR}
        SELECT 'loaded' AS step, 'orders_current' AS table_name, count(*) AS rows FROM cur
        UNION ALL SELECT 'loaded', 'orders_changelog', count(*) FROM ord_log
        UNION ALL SELECT 'reset', 'orders_current', 0 UNION ALL SELECT 'reset', 'orders_changelog', 0
        UNION ALL SELECT 'reloaded', 'orders_current', 0
        UNION ALL SELECT 'reloaded', 'orders_changelog', count(*) FROM ord_log WHERE cdc_operation = 'insert'""",
    "written_records": f"""WITH {_ORD_CUR} SELECT status, count(*) AS orders, '' AS missing FROM cur GROUP BY status""",
    "stream_changelog": f"WITH {_ORD_LOG} SELECT {_COLS}, cdc_row_kind, cdc_operation, source_ts_ms FROM ord_log",
    "stream_recovered_state": f"WITH {_ORD_LOG} {_current('ord_log')}",
    "statement_changes": f"""WITH {_ORD_LOG}, now AS ({_current('ord_log')}),
        hit AS (SELECT *, order_id % 3 AS third,
                       row_number() OVER (PARTITION BY order_id % 3 ORDER BY order_id) AS n FROM now)
        SELECT order_id, event_id, status, amount_cents, '-U' AS cdc_row_kind, n AS position
        FROM hit WHERE third = 0
        UNION ALL SELECT order_id, event_id, 'checked', amount_cents + 1, '+U', n FROM hit WHERE third = 0
        UNION ALL SELECT order_id, event_id, status, amount_cents, '-D', 1099511627775 + n
        FROM hit WHERE third = 1""",
    "restored_state": f"""WITH {_ORD_LOG}, now AS ({_current('ord_log')})
        SELECT * FROM now, (VALUES ('checkpoint'), ('copy'), ('session')) AS ways(way)""",
    "canonical_diff": """
        WITH e AS (SELECT event_id AS n, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events),
        docs AS (
            SELECT n, side, '{"amount":' || CASE WHEN c % 100 = 0 THEN CAST(c // 100 AS VARCHAR)
                        ELSE rtrim(printf('%d.%02d', c // 100, c % 100), '0') END
                   || ',"id":' || n || ',"kind":"' || event_type || '","nested":{"k":"A","list":[{"a":[1,null],"b":' || n % 7 || '}]}}' AS doc
            FROM (SELECT n, event_type, c, 'source' AS side FROM e UNION ALL
                  SELECT n, event_type, c + CASE WHEN n % 19 = 5 THEN 1 ELSE 0 END, 'target' FROM e WHERE n % 17 <> 3) x)
        SELECT 'missing' AS side, doc FROM docs a WHERE side = 'source' AND doc NOT IN (SELECT doc FROM docs WHERE side = 'target')
        UNION ALL
        SELECT 'unexpected', doc FROM docs a WHERE side = 'target' AND doc NOT IN (SELECT doc FROM docs WHERE side = 'source')""",
    "snapshot_diff": f"""WITH {_DAMAGED}
        SELECT 'missing' AS side, * FROM (SELECT {_COLS} FROM cur EXCEPT SELECT {_COLS} FROM dam) a
        UNION ALL
        SELECT 'unexpected', * FROM (SELECT {_COLS} FROM dam EXCEPT SELECT {_COLS} FROM cur) b""",
    "snapshot_diff_all": f"""WITH {_DAMAGED}
        SELECT side, {_COLS}, count(*) AS copies FROM (
            SELECT 'missing' AS side, * FROM (SELECT {_COLS} FROM cur EXCEPT ALL SELECT {_COLS} FROM dam) a
            UNION ALL
            SELECT 'unexpected', * FROM (SELECT {_COLS} FROM dam EXCEPT ALL SELECT {_COLS} FROM cur) b) z
        GROUP BY ALL""",
    "column_diff": f"""WITH {_DAMAGED},
        d AS (SELECT order_id, min(amount_cents) AS amount, count(*) AS n FROM dam GROUP BY order_id)
        SELECT coalesce(c.order_id, d.order_id) AS order_id,
               CASE WHEN d.order_id IS NULL THEN 'missing' WHEN c.order_id IS NULL THEN 'unexpected'
                    WHEN c.amount_cents <> d.amount THEN 'changed' ELSE 'repeated' END AS kind,
               CASE WHEN c.amount_cents <> d.amount THEN 'amount_cents' END AS first_column,
               CASE WHEN c.order_id IS NULL THEN 0 ELSE 1 END::BIGINT AS source_copies,
               coalesce(d.n, 0) AS target_copies
        FROM cur c FULL JOIN d ON c.order_id = d.order_id
        WHERE d.order_id IS NULL OR c.order_id IS NULL OR c.amount_cents <> d.amount OR d.n > 1""",
    "column_diff_copies": f"""WITH {_DAMAGED}
        SELECT order_id, 'changed' AS kind, 'amount_cents' AS first_column, CAST(2 AS BIGINT) AS source_copies,
               CAST(2 AS BIGINT) AS target_copies FROM cur WHERE order_id % 5 = 0""",
    "event_id_audit": f"""WITH {_DAMAGED}, {_SHORT_LOG}
        SELECT 'clean' AS target, {_audit('cur', 'ord_log')}
        UNION ALL SELECT 'damaged', {_audit('dam', 'short_log')}""",
    "reconcile_summary": f"""WITH {_DAMAGED}, {_SHORT_LOG}
        {_summary('cur', 'ord_log', 'clean')} UNION ALL {_summary('dam', 'short_log', 'damaged')}""",
    "uniqueness": f"""WITH {_DAMAGED}
        SELECT 'order_id' AS "column", CAST(order_id AS VARCHAR) AS value, count(*) AS copies
        FROM dam GROUP BY order_id HAVING count(*) > 1
        UNION ALL SELECT 'business_key', business_key, count(*) FROM dam GROUP BY business_key HAVING count(*) > 1
        UNION ALL SELECT 'event_id', CAST(event_id AS VARCHAR), count(*) FROM dam GROUP BY event_id HAVING count(*) > 1""",
    "status_match": f"""WITH {_DAMAGED}, n AS (
            SELECT (SELECT count(*) FROM (SELECT order_id, status FROM cur EXCEPT SELECT order_id, status FROM dam) a)
                 + (SELECT count(*) FROM (SELECT order_id, status FROM dam EXCEPT SELECT order_id, status FROM cur) b) AS d)
        SELECT 'clean' AS target, TRUE AS matches, CAST(0 AS BIGINT) AS diff_count
        UNION ALL SELECT 'damaged', d = 0, d FROM n""",
    "position_lag": f"""WITH {_EV_LOG}
        SELECT max(_seq) AS source_max_seq,
               max(_seq) FILTER (source_ts_ms // 86400000 <= 19737) AS committed_max_seq,
               max(_seq) - max(_seq) FILTER (source_ts_ms // 86400000 <= 19737) AS position_lag, CAST(0 AS BIGINT) AS file_lag
        FROM ev_log""",
    "scenario_final": f"""WITH {_SCEN}
        SELECT sid * 10000 + f.n AS order_id,
               'scenario-' || lpad(CAST(sid * 10000 + f.n AS VARCHAR), 12, '0') AS business_key,
               sid * 10000 + f.e AS event_id, sid AS customer_id,
               CASE WHEN f.e > 1000 THEN 'paid' ELSE 'created' END AS status,
               (sid * 10000 + f.n) * 10 + CASE WHEN f.e > 1000 THEN 1000 ELSE 0 END AS amount_cents,
               make_timestamp((sid * 10000 + f.e) * 1000) AS updated_at, 1 AS seed
        FROM runs JOIN {_SCEN_FINAL} ON f.kind = runs.kind""",
    # Damage by priority: 1 loses the updated row, 2 doubles the delete row, 5 keeps the deleted key.
    "scenario_summary": f"""WITH {_SCEN}
        SELECT kind, priority, count(*) AS scenarios,
               CAST(sum(CASE priority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 1 ELSE 0 END) AS BIGINT)
                   AS snapshot_diff_total,
               NOT (kind = 'crash' AND priority = '3-MEDIUM') AS passed,
               NOT (kind = 'crash' AND priority = '3-MEDIUM') AND priority NOT IN ('1-URGENT', '5-LOW')
                   AS all_snapshot_diffs_zero,
               NOT (kind = 'crash' AND priority = '3-MEDIUM') AND priority NOT IN ('1-URGENT', '2-HIGH', '5-LOW')
                   AS all_event_id_audits_consistent
        FROM runs GROUP BY kind, priority""",
    "smoke_checks": f"""WITH {_SCEN}
        SELECT kind, priority, count(*) AS runs,
               count(*) FILTER (priority <> '5-LOW') AS deleted_key_absent,
               count(*) FILTER (priority <> '1-URGENT') AS updated_key_current,
               count(*) AS changelog_long_enough
        FROM runs GROUP BY kind, priority""",
    "commit_lag": f"WITH {_HOURS} SELECT * FROM series",
    "commit_lag_total": """
        WITH s AS (SELECT event_type, event_id, ts < TIMESTAMP '2024-01-16' AS done FROM events
                   UNION ALL SELECT 'all', event_id, ts < TIMESTAMP '2024-01-16' FROM events),
        p AS (SELECT event_type, max(event_id) AS sm, coalesce(max(event_id) FILTER (done), 0) AS tm,
                     count(*) AS sn, count(*) FILTER (done) AS tn FROM s GROUP BY event_type)
        SELECT event_type, sm AS source_max_event_id, tm AS table_max_event_id,
               greatest(sm - tm, 0) AS max_event_id_gap, sn AS source_rows, tn AS changelog_rows,
               greatest(sn - tn, 0) AS lag_events FROM p""",
    "lag_phases": f"WITH {_PHASES} SELECT job, bucket, sample_index, elapsed_ms, phase, lag_events FROM phases",
    "recovery_streak": f"""WITH {_PHASES},
        runs AS (
            SELECT job, bucket, lag_events, sample_index,
                   CAST(CASE WHEN lag_events > 0 THEN 0 ELSE sample_index - coalesce(
                       (SELECT max(t.sample_index) FROM phases t WHERE t.job = p.job AND t.lag_events > 0
                        AND t.sample_index < p.sample_index), -1) END AS INTEGER) AS streak
            FROM phases p)
        SELECT job, bucket, lag_events, streak,
               streak = 3 AND NOT EXISTS (SELECT 1 FROM runs q WHERE q.job = r.job AND q.streak = 3
                                          AND q.sample_index < r.sample_index) AS stops_here
        FROM runs r""",
    "interval_max": """
        WITH s AS (
            SELECT DISTINCT event_type AS job, date_trunc('hour', ts) + INTERVAL 90 MINUTE AS sample_ts
            FROM events),
        b AS (SELECT job, sample_ts, lag(sample_ts) OVER (PARTITION BY job ORDER BY sample_ts) AS prev FROM s)
        SELECT b.job, b.sample_ts, count(e.event_id) AS points, max(e.value) AS max_value
        FROM b LEFT JOIN events e ON e.event_type = b.job AND e.ts <= b.sample_ts
             AND (b.prev IS NULL OR e.ts > b.prev)
        GROUP BY b.job, b.sample_ts""",
    "run_summary": f"""WITH {_PHASES},
        raw AS (
            SELECT job, sample_index AS i, phase,
                   CAST(lag_events * 3 + sample_index % 5 + 20 AS DOUBLE) AS dur,
                   CASE WHEN sample_index <> 1 THEN lag_events / 4.0 END AS ali,
                   CAST(sample_index // 100 AS DOUBLE) AS fail,
                   CASE WHEN sample_index % 2 = 0 THEN CAST(lag_events * 8 AS DOUBLE) END AS explicit,
                   CAST(NULL AS DOUBLE) AS flag,
                   CASE WHEN sample_index % 3 > 0 THEN CAST(lag_events * 16 AS DOUBLE) END AS busy,
                   CASE WHEN sample_index % 7 <> 6 THEN CAST(lag_events AS DOUBLE) END AS lagv
            FROM phases),
        x AS (SELECT *, CAST({_CASCADE} AS DOUBLE) AS ind FROM raw),
        g AS (
            SELECT job,
                max(dur) FILTER (phase = 'baseline') AS baseline_max_duration_ms,
                CAST(max(ali) FILTER (phase = 'baseline') AS DOUBLE) AS baseline_max_alignment_ms,
                max(ind) FILTER (phase = 'baseline') AS baseline_max_indicator,
                max(fail) FILTER (phase = 'baseline') AS baseline_max_failed,
                max(dur) FILTER (phase <> 'baseline') AS load_max_duration_ms,
                CAST(max(ali) FILTER (phase <> 'baseline') AS DOUBLE) AS load_max_alignment_ms,
                max(ind) FILTER (phase <> 'baseline') AS load_max_indicator,
                max(ind) FILTER (phase = 'backpressure') AS pressure_phase_max_indicator,
                max(ind) FILTER (phase = 'recovery') AS recovery_phase_max_indicator,
                max(lagv) FILTER (phase <> 'baseline') AS load_max_lag_events,
                (SELECT y.lagv FROM x y WHERE y.job = x.job AND y.lagv IS NOT NULL ORDER BY y.i DESC LIMIT 1)
                    AS final_lag_events,
                max(fail) AS failed_count_peak
            FROM x GROUP BY job),
        h AS (
            SELECT *, coalesce(load_max_duration_ms > baseline_max_duration_ms, FALSE) AS duration_rose,
                coalesce(load_max_alignment_ms > baseline_max_alignment_ms, FALSE) AS alignment_rose,
                failed_count_peak IS NOT NULL AS failure_count_recorded,
                coalesce(load_max_indicator, 0) >= 0.05 AS pressure_observed,
                coalesce(load_max_lag_events, 0) > 0 AS lag_observed,
                coalesce(final_lag_events = 0, FALSE) AS lag_recovered
            FROM g)
        SELECT *, duration_rose AND alignment_rose AND failure_count_recorded AND pressure_observed
               AND lag_observed AND lag_recovered AS passed,
               coalesce(load_max_indicator > baseline_max_indicator, FALSE) AS pressure_rose,
               coalesce(failed_count_peak > baseline_max_failed, FALSE) AS failures_rose
        FROM h""",
    "pressure_cascade": f"""
        WITH e AS (
            SELECT event_id,
                   CASE event_type WHEN 'click' THEN 0.0::DOUBLE WHEN 'view' THEN NULL ELSE value * 10 END AS explicit,
                   CASE WHEN {_K} % 5 <> 0 THEN CASE event_type WHEN 'error' THEN 1.0::DOUBLE WHEN 'signup' THEN NULL
                        ELSE 0.0::DOUBLE END END AS flag,
                   CASE WHEN {_K} % 3 <> 0 THEN {_K} * 12.0::DOUBLE END AS busy
            FROM events)
        SELECT *, CAST({_CASCADE} AS DOUBLE) AS indicator FROM e""",
    "metric_lines": f"WITH {_METRICS} SELECT event_id, name, job_id, event, CAST(v AS DOUBLE) AS value FROM m",
    "metric_max": f"""WITH {_METRICS}, j AS (SELECT * FROM m WHERE job_id IS NULL OR job_id = 'job-1'),
        q AS (SELECT max(v) FILTER (event_type = 'click')::DOUBLE AS d, max(v) FILTER (event_type = 'purchase')::DOUBLE AS a,
                     max(v) FILTER (event_type = 'view')::DOUBLE AS explicit,
                     max(v) FILTER (event_type = 'signup')::DOUBLE AS busy, NULL::DOUBLE AS flag FROM j)
        SELECT d AS checkpoint_duration_ms, 'engine_job_lastCheckpointDuration' AS checkpoint_duration_ms_name,
               a / 1000000.0 AS checkpoint_alignment_time_ms, CAST(NULL AS DOUBLE) AS checkpoint_failed_count,
               explicit AS backpressured_time_ms_per_second, busy AS busy_time_ms_per_second,
               CAST({_CASCADE} AS DOUBLE) AS pressure_indicator FROM q""",
    "json_path_max": f"""
        SELECT event_id, 'alignment' AS what, CAST(greatest({_CENTS} + 1, 12) AS DOUBLE) AS max_number FROM events
        UNION ALL SELECT event_id, 'delay', CAST({_K} AS DOUBLE) FROM events""",
    "checkpoint_history": f"""
        SELECT event_id, event_id AS checkpoint_id,
               CAST(CASE WHEN event_type = 'error' THEN {_CENTS} + 5 ELSE {_CENTS} END AS DOUBLE) AS duration_ms
        FROM events
        UNION ALL SELECT event_id, event_id - 1, CAST({_CENTS} + 1 AS DOUBLE) FROM events""",
    "latest_checkpoint": f"""
        SELECT event_id, event_id AS checkpoint_id,
               CAST(CASE WHEN event_type = 'error' THEN {_CENTS} + 5 ELSE {_CENTS} END AS DOUBLE) AS duration_ms
        FROM events""",
    "restorable_checkpoint": f"""
        WITH c AS (
            SELECT event_id, event_id AS id, 0 AS nth, {_CENTS} AS d FROM events WHERE event_type <> 'error'
            UNION ALL SELECT event_id, event_id, 1, {_CENTS} + 5 FROM events
            UNION ALL SELECT event_id, event_id - 1, 2, {_CENTS} + 1 FROM events),
        p AS (SELECT event_id, arg_min(id, nth) AS id, arg_min(d, nth) AS d FROM c WHERE id % 4 <> 0 GROUP BY event_id)
        SELECT e.event_id, p.id AS checkpoint_id, CAST(p.d AS DOUBLE) AS duration_ms, 'chk-' || p.id AS external_path
        FROM events e LEFT JOIN p ON e.event_id = p.event_id""",
    "checkpoint_record": f"""
        WITH e AS (SELECT event_id, event_type = 'view' AS v, CAST({_CENTS} AS BIGINT) AS c FROM events)
        SELECT event_id, event_id AS checkpoint_id, 'COMPLETED' AS status, event_id * 1000 AS trigger_timestamp,
               event_id * 1000 + c AS latest_ack_timestamp, CAST(CASE WHEN v THEN c + 1 ELSE c END AS DOUBLE) AS duration_ms,
               CAST(CASE WHEN v THEN event_id END AS DOUBLE) AS alignment_time_ms,
               CAST(CASE WHEN v THEN 3 ELSE 7 END AS DOUBLE) AS alignment_buffered_bytes,
               CAST(CASE WHEN v THEN event_id + 1 END AS DOUBLE) AS start_delay_ms,
               CAST(c * 2 AS DOUBLE) AS checkpointed_size_bytes, CAST(NULL AS DOUBLE) AS processed_data_bytes,
               CAST(NULL AS DOUBLE) AS persisted_data_bytes
        FROM e""",
    "first_kept": """
        SELECT user_id, event_type, event_id, value, ts FROM events e
        WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.user_id = e.user_id
                          AND f.event_type = e.event_type AND f.event_id < e.event_id)""",
    "size_stats": f"WITH {_SIZES} {_stats('sizes')}",
    "timing_median": f"""WITH {_SIZES}
        SELECT lang, round(CAST(median(length * 1234567) AS DOUBLE) / 1e6, 3) AS median_ms FROM sizes GROUP BY lang""",
    "layout_deltas": f"""WITH {_SIZES},
        merged AS (SELECT source, lang, CAST(sum(length) AS BIGINT) AS length FROM sizes GROUP BY source, lang),
        b AS ({_stats('sizes')}), a AS ({_stats('merged')}),
        j AS (SELECT b.source, CAST(b.data_file_count AS DOUBLE) AS bn, CAST(a.data_file_count AS DOUBLE) AS an,
                     b.median_file_size_bytes AS bm, a.median_file_size_bytes AS am
              FROM b JOIN a ON a.source = b.source)
        SELECT source, an - bn AS data_file_count_delta, an < bn AS data_file_count_decreased,
               least(an, 4) - least(bn, 4) AS commit_count_delta, least(an, 4) < least(bn, 4) AS commit_count_decreased,
               am - bm AS median_file_size_bytes_delta, am > bm AS median_file_size_bytes_increased,
               an * 0.5 - bn * 0.5 AS planning_latency_ms_delta, an * 0.5 < bn * 0.5 AS planning_latency_ms_decreased
        FROM j""",
    "gen_sequence": """
        SELECT o_orderkey + 2000000 AS order_id,
               'order-' || lpad(CAST(o_orderkey + 2000000 AS VARCHAR), 12, '0') AS business_key,
               o_orderkey + 2000000 AS event_id, 10000 + o_orderkey % 1000 AS customer_id,
               CASE o_orderkey % 5 WHEN 0 THEN 'created' WHEN 1 THEN 'paid' WHEN 2 THEN 'packed'
                    WHEN 3 THEN 'shipped' ELSE 'delivered' END AS status,
               25000 + o_orderkey AS amount_cents,
               TIMESTAMP '2026-01-01' + to_seconds(o_orderkey) AS updated_at, 222 AS seed
        FROM orders""",
    "gen_seeded": f"""
        WITH d AS (
            SELECT o_orderkey AS k, ('0x' || substr(md5(o_orderkey || ':1:1'), 1, 15))::BIGINT AS a,
                   ('0x' || substr(md5(o_orderkey || ':1:2'), 1, 15))::BIGINT AS b,
                   ('0x' || substr(md5(o_orderkey || ':1:3'), 1, 15))::BIGINT AS c FROM orders)
        SELECT k AS order_id, 'order-' || lpad(CAST(k AS VARCHAR), 12, '0') AS business_key, k AS event_id,
               a % {feeds.MAX_CUSTOMERS} + 1 AS customer_id,
               {list(feeds.STATUSES)}[b % {len(feeds.STATUSES)} + 1] AS status,
               c % {feeds.AMOUNT_SPAN} + {feeds.AMOUNT_FLOOR} AS amount_cents,
               TIMESTAMP '2026-01-01' + to_seconds(k) AS updated_at, 1 AS seed
        FROM d""",
    "tsv_rows": f"""WITH {_ORD_CUR}
        SELECT order_id || chr(9) || business_key || chr(9) || event_id || chr(9) ||
               CASE WHEN status = 'paid' THEN 'NULL' ELSE CAST(customer_id AS VARCHAR) END || chr(9) || status
               || chr(9) || amount_cents || chr(9) || strftime(updated_at, '%Y-%m-%d %H:%M:%S.%g') || chr(9) || seed AS line
        FROM cur""",
    "clean_lines": r"""
        WITH l AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS t,
                   unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents)
        SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, t AS value FROM l
        WHERE source NOT IN ('src1', 'src2', 'src3') AND regexp_matches(t, '\S')
              AND NOT regexp_matches(t, '^(WARNING:|SLF4J:|log4j:WARN)')""",
    "contract_violations": f"""
        WITH r AS (SELECT 'r' || o_orderkey || '.json' AS file_name, o_orderpriority AS p, o_orderstatus AS s FROM orders)
        SELECT file_name, 'missing git_sha' AS rule FROM r WHERE p = '1-URGENT'
        UNION ALL SELECT file_name, 'stack_versions is not an object' FROM r WHERE p = '2-HIGH'
        UNION ALL SELECT file_name, 'results is not a non-empty list' FROM r WHERE p = '4-NOT SPECIFIED' AND s = 'F'
        UNION ALL SELECT file_name, 'a result lacks a numeric snapshot_diff_count' FROM r WHERE p = '3-MEDIUM' AND s = 'F'
        UNION ALL SELECT file_name, o.f || ' is not an object' FROM r, (VALUES {_OBJ}) o(f) WHERE p = '5-LOW' AND s = 'O'
        UNION ALL SELECT file_name, 'check failed or missing: ' || c.f FROM r, (VALUES {_CHK}) c(f)
                  WHERE s = 'O' AND (p = '5-LOW' OR (p IN ('2-HIGH', '3-MEDIUM') AND c.f = 'commit_count_decreased'))""",
    "artifact_index": """
        SELECT 'r' || o_orderkey || '.json' AS file_name, CAST(NULL AS VARCHAR) AS phase, 'r' || o_orderkey AS title,
               'r' || o_orderkey AS run_id,
               CASE WHEN o_orderpriority <> '1-URGENT' THEN 'abc' END AS git_sha,
               strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS started_at,
               strftime(o_orderdate + to_seconds(o_custkey), '%Y-%m-%dT%H:%M:%SZ') AS finished_at,
               'run' AS command, 'l.log' AS logs, o_custkey AS duration_seconds,
               CASE WHEN o_orderstatus <> 'O' OR o_orderpriority = '5-LOW' THEN 'synced'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'recorded' WHEN o_orderpriority = '2-HIGH' THEN 'failed'
                    ELSE 'passed' END AS status
        FROM orders""",
    "evidence_rollup": """
        SELECT 'r' || o_orderkey || '.json' AS file_name, 'c' || (o_orderkey % 3) AS failure_class,
               CAST(2 AS BIGINT) AS results,
               CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0 ELSE 2 * o_custkey END AS snapshot_diff_count
        FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '4-NOT SPECIFIED'""",
    "text_numbers": """
        WITH t AS (
            SELECT o_orderkey, CASE o_orderpriority
                WHEN '1-URGENT' THEN o_custkey WHEN '2-HIGH' THEN o_custkey
                WHEN '3-MEDIUM' THEN CAST('99999999' || o_custkey AS BIGINT)
                WHEN '4-NOT SPECIFIED' THEN NULL ELSE -o_custkey END AS n FROM orders)
        SELECT o_orderkey, CASE WHEN n <= 2147483647 THEN CAST(n AS INTEGER) END AS as_int, n AS as_bigint FROM t""",
    "output_objects": """
        SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN '{"id": ' || o_orderkey || '}' END AS doc,
               CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE 0 END AS row_count, CAST(0 AS BIGINT) AS file_count
        FROM orders""",
    "merged_readings": """
        WITH r AS (
            SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS a,
                   CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS DOUBLE) END AS b FROM events)
        SELECT event_id, coalesce(a, b) AS first_reading, greatest(a, b) AS largest_reading FROM r""",
    "tsv_round_trip": f"""WITH {_ORD_CUR}
        SELECT order_id, business_key, CASE WHEN status <> 'paid' THEN status END AS status, amount_cents FROM cur""",
    "sql_asof": """
        SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value
        FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
          ON p.user_id = v.user_id AND p.event_id > v.event_id""",
}

for _name, _text in conformance.STATEMENTS.items():
    ORACLES[_name] = _text
ORACLES["sql_scalars"] = (
    conformance.STATEMENTS["sql_scalars"]
    .replace("AS STRING", "AS VARCHAR")
    .replace("split(p_type, ' ')[0]", "string_split(p_type, ' ')[1]")
)
ORACLES["sql_cube"] = conformance.STATEMENTS["sql_cube"].replace("dayofweek(ts)", "(dayofweek(ts) + 1)")
ORACLES["sql_pivot"] = """
    SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'partial' END AS status,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_custkey, o_orderstatus"""
ORACLES["sql_nested"] = """
    WITH baskets AS (
        SELECT l_orderkey, list({'q': CAST(l_quantity AS BIGINT)} ORDER BY l_linenumber, CAST(l_quantity AS BIGINT), CAST(l_shipdate AS DATE)) AS a,
               min(CAST(l_shipdate AS DATE)) AS first_ship, max(CAST(l_shipdate AS DATE)) AS last_ship
        FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, CAST(len(a) AS INTEGER) AS line_count,
           array_to_string(list_transform(a, lambda x: CAST(x.q AS VARCHAR)), ',') AS quantities,
           CAST(list_sum(list_transform(a, lambda x: x.q)) AS BIGINT) AS total,
           CAST(len(list_filter(a, lambda x: x.q >= 25)) AS INTEGER) AS large_lines,
           list_contains(list_transform(a, lambda x: x.q), 50) AS has_full_line,
           a[1].q AS first_quantity, len(a) >= 3 AS has_third, a[1].q AS json_first,
           CAST(last_ship - first_ship AS INTEGER) AS days, CAST(first_ship + INTERVAL 1 MONTH AS DATE) AS next_month,
           last_day(first_ship) AS month_end, CAST(date_trunc('quarter', first_ship) AS DATE) AS quarter_start,
           CAST(week(first_ship) AS INTEGER) AS week
    FROM baskets"""
