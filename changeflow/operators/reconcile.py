"""Reconciliation: snapshot diffs, id audits, lag and scenario summaries.

Every comparison tags both sides, unions them and groups once. Copies of a row collapse before
the shuffle, nothing is joined row by row, and only summary rows leave the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions import scalars as S
from changeflow.schemas import CURRENT_COLUMNS

MISSING, UNEXPECTED = "missing", "unexpected"


def normalise(rows: DataFrame, columns: Sequence[str] = CURRENT_COLUMNS) -> DataFrame:
    """The compared columns, timestamps cut to milliseconds."""
    types = dict(rows.dtypes)
    cut = lambda c: S.micros_to_timestamp(S.floor_div(S.epoch_micros(c), 1000) * 1000)
    return rows.select(
        *[
            cut(F.col(c)).alias(c) if types[c] == "timestamp_ntz" else F.col(c)
            for c in columns
        ]
    )


def side_counts(
    source: DataFrame, target: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """How often each distinct row occurs on either side; ``by`` names the case a row belongs to."""
    columns = [*by, *columns]
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    left = normalise(source, columns).select("*", one.alias("_s"), zero.alias("_t"))
    right = normalise(target, columns).select("*", zero.alias("_s"), one.alias("_t"))
    return (
        left.unionByName(right)
        .groupBy(*columns)
        .agg(F.sum("_s").alias("source_copies"), F.sum("_t").alias("target_copies"))
    )


def snapshot_diff(
    source: DataFrame, target: DataFrame, columns: Sequence[str] = CURRENT_COLUMNS
) -> DataFrame:
    """Rows on one side only; copies count once and a changed row shows on both sides."""
    in_source, in_target = F.col("source_copies") > 0, F.col("target_copies") > 0
    return (
        side_counts(source, target, columns)
        .filter(in_source != in_target)
        .select(F.when(in_source, MISSING).otherwise(UNEXPECTED).alias("side"), *columns)
    )


def snapshot_diff_all(
    source: DataFrame, target: DataFrame, columns: Sequence[str] = CURRENT_COLUMNS
) -> DataFrame:
    """Like :func:`snapshot_diff`, copies included: ``copies`` says how many are too few or too many."""
    surplus = F.col("source_copies") - F.col("target_copies")
    return (
        side_counts(source, target, columns)
        .filter(surplus != 0)
        .select(
            F.when(surplus > 0, MISSING).otherwise(UNEXPECTED).alias("side"),
            *columns,
            F.abs(surplus).alias("copies"),
        )
    )


def canonical_diff(source: DataFrame, target: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Set difference of JSON documents: what differs in key order, blanks or the writing of a number or a
    string alone is the same document. Text that is no JSON is compared as it is.
    """
    canonical = lambda df: df.select(*by, F.coalesce(S.canonical_json(F.col(column)), F.col(column)).alias(column))
    return snapshot_diff(canonical(source), canonical(target), [*by, column])


def column_diff(
    source: DataFrame,
    target: DataFrame,
    key: str = "order_id",
    columns: Sequence[str] = CURRENT_COLUMNS,
) -> DataFrame:
    """Per key: missing, unexpected, changed (with the first differing column) or repeated.

    Copies of each row are counted on both sides first, then folded to the key: a key whose rows
    differ on the sides is ``changed`` even if it has as many rows on both; ``repeated`` means the
    same rows in other numbers. ``first_column`` compares the largest row that one side has too
    many of with the largest of the other. Only sums and single rows leave a task.
    """
    values = [c for c in columns if c != key]
    s, t, row = F.col("source_copies"), F.col("target_copies"), F.struct(*values)
    folded = (
        side_counts(source, target, columns)
        .groupBy(key)
        .agg(
            F.sum(s).alias("source_copies"),
            F.sum(t).alias("target_copies"),
            F.max((s > 0) != (t > 0)).alias("_changed"),
            F.max(s != t).alias("_differs"),
            F.max(F.when(s > t, row)).alias("_sr"),
            F.max(F.when(t > s, row)).alias("_tr"),
        )
    )
    both = (s > 0) & (t > 0)
    paired = F.col("_sr").isNotNull() & F.col("_tr").isNotNull()
    first = F.coalesce(
        *[F.when(~F.col("_sr")[c].eqNullSafe(F.col("_tr")[c]), F.lit(c)) for c in values]
    )
    kind = (
        F.when(t == 0, "missing")
        .when(s == 0, "unexpected")
        .when(F.col("_changed"), "changed")
        .when(F.col("_differs"), "repeated")
    )
    return (
        folded.withColumn("kind", kind)
        .filter("kind is not null")
        .select(
            key,
            "kind",
            F.when(both & paired, first).alias("first_column"),
            "source_copies",
            "target_copies",
        )
    )


def _side(df: DataFrame, id_column: str, flag: str, by: Sequence[str]) -> DataFrame:
    flags = ["_source", "_target", "_expected", "_log", "_expected_log"]
    return df.select(
        *by,
        F.col(id_column).cast("bigint").alias("event_id"),
        *[F.lit(1 if f == flag else 0).cast("bigint").alias(f) for f in flags],
    )


def event_id_presence(
    source: DataFrame,
    target: DataFrame,
    expected: DataFrame,
    changelog: DataFrame,
    expected_changelog: DataFrame,
    id_column: str = "event_id",
    by: Sequence[str] = (),
) -> DataFrame:
    """For every id (of every case), how often each of the five inputs holds it."""
    tagged = _side(source, id_column, "_source", by)
    for df, flag in (
        (target, "_target"),
        (expected, "_expected"),
        (changelog, "_log"),
        (expected_changelog, "_expected_log"),
    ):
        tagged = tagged.unionByName(_side(df, id_column, flag, by))
    return tagged.groupBy(*by, "event_id").agg(
        *[F.sum(f).alias(f) for f in ("_source", "_target", "_expected", "_log", "_expected_log")]
    )


def event_id_audit(
    source: DataFrame,
    target: DataFrame,
    expected: DataFrame,
    changelog: DataFrame,
    expected_changelog: DataFrame,
    id_column: str = "event_id",
    by: Sequence[str] = (),
) -> DataFrame:
    """One row: do the current ids agree three ways, and does the changelog hold what it should.

    ``expected_changelog`` lists every expected changelog row's id, repeats included. With ``by``,
    columns of all five inputs, many cases are audited at once: one row per case.
    """
    ids = event_id_presence(source, target, expected, changelog, expected_changelog, id_column, by)
    has = lambda c: F.col(c) > 0
    n = lambda c: F.count_if(has(c))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    every = lambda cond: F.coalesce(F.every(cond), F.lit(True))
    audit = ids.groupBy(*by).agg(
        n("_source").alias("source_current_ids"),
        n("_target").alias("target_current_ids"),
        n("_expected").alias("expected_current_ids"),
        every((has("_source") == has("_target")) & (has("_target") == has("_expected"))).alias(
            "current_sets_match"
        ),
        n("_log").alias("changelog_distinct_ids"),
        n("_expected_log").alias("expected_changelog_ids"),
        every(has("_log") == has("_expected_log")).alias("changelog_set_match"),
        total("_log").alias("changelog_row_count"),
        total("_expected_log").alias("expected_changelog_row_count"),
    )
    rows_match = F.col("changelog_row_count") == F.col("expected_changelog_row_count")
    return audit.withColumn("changelog_row_count_match", rows_match).withColumn(
        "consistent", F.col("current_sets_match") & F.col("changelog_set_match") & rows_match
    )


def reconcile_summary(
    source: DataFrame,
    target: DataFrame,
    expected: DataFrame,
    changelog: DataFrame,
    expected_changelog: DataFrame,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row (per case) with row counts, diff counts and the id audit."""
    missing = (F.col("source_copies") > 0) & (F.col("target_copies") == 0)
    unexpected = (F.col("target_copies") > 0) & (F.col("source_copies") == 0)
    zero = F.lit(0).cast("bigint")
    diff = side_counts(source, target, CURRENT_COLUMNS, by).groupBy(*by).agg(
        F.coalesce(F.sum("source_copies"), zero).alias("source_row_count"),
        F.coalesce(F.sum("target_copies"), zero).alias("target_row_count"),
        F.count_if(missing).alias("missing_count"),
        F.count_if(unexpected).alias("unexpected_count"),
        F.count_if(missing | unexpected).alias("snapshot_diff_count"),
        F.coalesce(F.sum(F.abs(F.col("source_copies") - F.col("target_copies"))), zero).alias(
            "multiset_diff_count"
        ),
    )
    audit = event_id_audit(source, target, expected, changelog, expected_changelog, by=by)
    # Two one-row results become one by union and max: every column is set in exactly one of them.
    both = diff.unionByName(audit, allowMissingColumns=True)
    row = both.groupBy(*by).agg(*[F.max(c).alias(c) for c in both.columns if c not in by])
    return row.withColumn("reconciled", (F.col("snapshot_diff_count") == 0) & F.col("consistent"))


def progress(rows: DataFrame, column: str = "event_id") -> DataFrame:
    """Largest id (0 if none) and row count."""
    return rows.agg(
        F.coalesce(F.max(column), F.lit(0)).cast("bigint").alias("max_id"),
        F.count(F.lit(1)).alias("rows"),
    )


def commit_lag(
    source: DataFrame, changelog: DataFrame, column: str = "event_id", by: Sequence[str] = ()
) -> DataFrame:
    """Rows and ids the table is behind its source; never negative. One pass over both."""
    tag = lambda df, c: df.select(*by, F.col(column).alias("_id"), F.lit(c).alias("_side"))
    both = tag(source, "s").unionByName(tag(changelog, "t"))
    is_s, is_t = F.col("_side") == "s", F.col("_side") == "t"
    top = lambda cond: F.coalesce(F.max(F.when(cond, F.col("_id"))), F.lit(0)).cast("bigint")
    return both.groupBy(*by).agg(
        top(is_s).alias("source_max_event_id"),
        top(is_t).alias("table_max_event_id"),
        F.greatest(top(is_s) - top(is_t), F.lit(0)).cast("bigint").alias("max_event_id_gap"),
        F.count_if(is_s).alias("source_rows"),
        F.count_if(is_t).alias("changelog_rows"),
        F.greatest(F.count_if(is_s) - F.count_if(is_t), F.lit(0)).cast("bigint").alias("lag_events"),
    )


def position_lag(source: DataFrame, committed: DataFrame) -> DataFrame:
    """How far the committed changes are behind the source log; also right when rows are deleted.

    Across log files ``file_lag`` counts the files between, and ``position_lag`` is the source's
    offset in its own file, all of which is still to come.
    """
    zero = F.lit(0).cast("bigint")
    place = lambda df: F.struct(
        (F.col("_file") if "_file" in df.columns else zero).alias("file"), F.col("_seq").alias("seq")
    )
    side = lambda df, c: df.agg(F.max(place(df)).alias(c))
    both = side(source, "s").unionByName(side(committed, "c"), allowMissingColumns=True)
    part = lambda c, name: F.coalesce(F.max(c)[name], zero)
    row = both.agg(
        part("s", "seq").alias("source_max_seq"), part("c", "seq").alias("committed_max_seq"),
        F.greatest(part("s", "file") - part("c", "file"), zero).alias("file_lag"),
    )
    behind = F.col("source_max_seq") - F.when(F.col("file_lag") == 0, F.col("committed_max_seq")).otherwise(zero)
    return row.select("source_max_seq", "committed_max_seq", F.greatest(behind, zero).alias("position_lag"), "file_lag")


def repeated_keys(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that should be unique and are not, for several columns in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        rows.select(F.explode(pairs).alias("p"))
        .groupBy("p.column", "p.value")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def scenario_audit(sides: DataFrame, by: Sequence[str]) -> DataFrame:
    """The id audit of many scenarios at once, from rows that say how often each side holds an id.

    ``sides``: the columns ``by`` that name a scenario, ``event_id``, and the counts ``source, target,
    expected, log, expected_log``; rows of one id add up. One row per scenario, labels among ``by`` kept.
    """
    names = ("source", "target", "expected", "log", "expected_log")
    ids = sides.groupBy(*by, "event_id").agg(*[F.sum(n).alias(n) for n in names])
    has = lambda c: F.col(c) > 0
    same = (has("source") == has("target")) & (has("target") == has("expected")) & (has("log") == has("expected_log"))
    return ids.groupBy(*by).agg(
        F.count_if(has("source") != has("target")).alias("id_diff_count"),
        F.sum("log").alias("changelog_rows"),
        (F.every(same) & (F.sum("log") == F.sum("expected_log"))).alias("consistent"),
    )


def scenario_summary(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Roll scenario rows up. With no scenario at all nothing has passed."""
    some = F.count(F.lit(1)) > 0
    yes = lambda cond: F.coalesce(F.every(cond), F.lit(False)) & some
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scenarios"),
        F.sum("snapshot_diff_count").cast("bigint").alias("snapshot_diff_total"),
        yes(F.col("error").isNull()).alias("passed"),
        yes(F.col("error").isNull() & (F.col("snapshot_diff_count") == 0)).alias("all_snapshot_diffs_zero"),
        yes(F.col("error").isNull() & F.col("consistent")).alias("all_event_id_audits_consistent"),
    )


def smoke_checks(rows: DataFrame, by: Sequence[str], deleted: Column, updated: Column, least: Column) -> DataFrame:
    """Per scenario: deleted key absent, updated key current, changelog of ``least`` rows or more.

    ``rows`` hold the columns ``by`` and the counts ``target`` and ``log``; ``deleted`` and ``updated`` say which of
    them are the deleted key and the current image of the updated one. One grouping for all three.
    """
    held = F.col("target") > 0
    return rows.groupBy(*by).agg(
        (~F.some(held & deleted)).alias("deleted_key_absent"),
        F.some(held & updated).alias("updated_key_current"),
        (F.sum("log") >= least).alias("changelog_long_enough"),
    )


def same_statuses(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: does ``(order_id, status)`` match the expected map exactly."""
    diff = snapshot_diff(expected, rows, ["order_id", "status"])
    return diff.agg((F.count(F.lit(1)) == 0).alias("matches"), F.count(F.lit(1)).alias("diff_count"))
