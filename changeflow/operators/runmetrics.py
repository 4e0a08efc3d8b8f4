"""Run metrics: reporter lines, checkpoint history, sample series, run summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeflow.functions import scalars as S
from changeflow.functions.windows import running
from changeflow.schemas import CHECKPOINTS, SAMPLE

# Metric names looked for (by normalised suffix), limits of the checks.
SUFFIXES = {
    "checkpoint_duration_ms": ("lastCheckpointDuration",),
    "checkpoint_alignment_time_ms": (
        "lastCheckpointAlignmentDuration",
        "checkpointAlignmentTime",
        "alignmentDuration",
    ),
    "checkpoint_alignment_buffered_bytes": ("lastCheckpointAlignmentBuffered",),
    "checkpoint_failed_count": ("numberOfFailedCheckpoints",),
    "backpressured_time_ms_per_second": ("backPressuredTimeMsPerSecond",),
    "is_backpressured": ("isBackPressured",),
    "busy_time_ms_per_second": ("busyTimeMsPerSecond",),
}
#: Stands between the parts of a metric line.
_MARK = "\x01"
MIN_PRESSURE = 0.05
RECOVERED_AFTER = 3
BASELINE, LOADED, RECOVERY = "baseline", "backpressure", "recovery"
#: Seconds of a job's samples that are looked at together.
SLICE = 86_400


def metric_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines to ``name, labels, value``; comments and lines that do not fit are dropped."""
    text = F.trim(F.col(column))
    others = [c for c in lines.columns if c != column]
    # One run of the pattern a line: what it puts between its parts tells whether it fitted. A line that
    # holds that sign itself is read part by part. No comment can match: a name does not start with "#".
    cut = F.split(F.regexp_replace(text, S.METRIC_LINE, f"$1{_MARK}$2{_MARK}$3"), _MARK)
    each = F.array(*[F.regexp_extract(text, S.METRIC_LINE, n) for n in (1, 2, 3)])
    parts = F.when(F.contains(text, F.lit(_MARK)), F.when(text.rlike(S.METRIC_LINE), each)).otherwise(cut)
    # Exploding keeps the list a value, so that neither the filter nor the columns build it again.
    fitting = F.filter(F.array(parts), lambda p: F.size(p) == 3)
    found = lines.select(*others, F.explode(fitting).alias("_parts"))
    part = lambda n: F.element_at("_parts", n)
    return found.select(
        *others, part(1).alias("name"), S.labels_map(part(2)).alias("labels"), part(3).cast("double").alias("value")
    )


def job_metrics(metrics: DataFrame, job: str) -> DataFrame:
    """Metrics of one job; those without a job label belong to every job."""
    named = lambda key: F.nullif(F.try_element_at("labels", F.lit(key)), F.lit(""))
    label = F.coalesce(named("job_id"), named("job"))
    return metrics.filter(label.isNull() | (label == job))


def _ends_with_any(key: Column, suffixes: Sequence[str]) -> Column:
    hit = F.lit(False)
    for suffix in suffixes:
        hit = hit | F.endswith(key, F.lit("".join(ch for ch in suffix.lower() if ch.isalnum())))
    return hit


def reporter_snapshot(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest value and its metric name for every quantity, in one pass, plus the indicator.

    Among equal values the smallest name is reported, so the result does not depend on order.
    """
    aggs = []
    for quantity, suffixes in SUFFIXES.items():
        hit = _ends_with_any(F.col("_key"), suffixes)
        value = F.when(hit, F.col("value"))
        aggs += [
            F.max(value).alias(quantity),
            F.min_by(F.when(hit, F.col("name")), F.when(hit, F.struct((-F.col("value")), "name"))).alias(
                f"{quantity}_name"
            ),
        ]
    snap = metrics.withColumn("_key", S.metric_key(F.col("name"))).groupBy(*by).agg(*aggs)
    aligned = S.alignment_ms(
        F.col("checkpoint_alignment_time_ms"), F.col("checkpoint_alignment_time_ms_name")
    )
    return snap.withColumn("checkpoint_alignment_time_ms", aligned).withColumn(
        "pressure_indicator",
        S.pressure_indicator(
            F.col("backpressured_time_ms_per_second"),
            F.col("is_backpressured"),
            F.col("busy_time_ms_per_second"),
        ),
    )


def numeric_leaves(
    docs: DataFrame, column: str, keys: Sequence[str], max_depth: int | None = None
) -> DataFrame:
    """Every number in JSON text with its dotted path, in one narrow stage.

    With ``max_depth`` a document that nests deeper stops the job.
    """
    text = F.col(column)
    if max_depth is not None:
        deep = F.try_parse_json(text).isNotNull() & (S.json_depth(text) > max_depth)
        text = F.when(deep, F.raise_error(F.lit("document nests too deep"))).otherwise(text)
    return docs.select(*keys, text.alias("_text")).select(*keys, F.inline(S.json_numbers(F.col("_text"))))


def path_maxima(column: str, wanted: dict[str, tuple[Sequence[str], Sequence[str]]]) -> list[Column]:
    """Of a list of :func:`scalars.json_numbers`, the largest number below matching paths, as columns.

    ``wanted`` is that of :func:`path_max`; nothing leaves the row.
    """
    out = []
    for name, (include, suffixes) in wanted.items():

        def hit(leaf: Column) -> Column:
            found = F.lit(True)
            for part in include:
                found = found & F.contains(S.metric_key(leaf["path"]), S.metric_key(F.lit(part)))
            return found & _ends_with_any(S.metric_key(leaf["last"]), suffixes) if suffixes else found

        held = F.filter(F.col(column), hit)
        out.append(F.array_max(F.transform(held, lambda leaf: leaf["number"])).alias(name))
    return out


def path_max(
    leaves: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Sequence[str], Sequence[str]]]
) -> DataFrame:
    """Largest number below matching paths, one column per entry of ``wanted``, in one pass.

    An entry gives the parts a path must hold and the endings its last part may have.
    """
    keyed = leaves.withColumn("_path", S.metric_key(F.col("path"))).withColumn(
        "_last", S.metric_key(F.col("last"))
    )
    aggs = []
    for name, (include, suffixes) in wanted.items():
        hit = F.lit(True)
        for part in include:
            hit = hit & F.contains("_path", S.metric_key(F.lit(part)))
        if suffixes:
            hit = hit & _ends_with_any(F.col("_last"), suffixes)
        aggs.append(F.max(F.when(hit, F.col("number"))).alias(name))
    return keyed.groupBy(*keys).agg(*aggs)


def _completed_lists(payloads: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Per document the completed checkpoints, the latest one first, each id once (``done``).

    Histories are short lists inside one row, so repeats go without a shuffle.
    """
    latest = F.array("d.latest.completed")
    history = F.filter("d.history", lambda h: h["status"] == "COMPLETED")
    listed = F.concat(latest, F.coalesce(history, F.slice(latest, 1, 0)))
    done = F.col("done")
    once = F.filter(
        done, lambda c, i: ~F.exists(F.slice(done, F.lit(1), i), lambda earlier: earlier["id"] == c["id"])
    )
    return (
        payloads.select(*keys, F.from_json(column, CHECKPOINTS).alias("d"))
        .select(*keys, F.filter(listed, lambda c: c["id"].isNotNull()).alias("done"))
        .select(*keys, once.alias("done"))
    )


def _checkpoint(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.select(
        *keys, F.col("c.id").alias("checkpoint_id"), F.col("c.end_to_end_duration").alias("duration_ms")
    )


def completed_checkpoints(payloads: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Completed checkpoints of each status document, each id once (the first kept)."""
    lists = _completed_lists(payloads, column, keys)
    # Outer, so that no predicate on the list is inferred and the list computed twice.
    rows = lists.select(*keys, F.explode_outer("done").alias("c")).filter("c is not null")
    return _checkpoint(rows, keys)


def latest_completed(payloads: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """The completed checkpoint with the largest id of each document; nulls without one."""
    lists = _completed_lists(payloads, column, keys)
    newest = F.array_max(F.transform("done", lambda c: F.struct(c["id"].alias("id"), c.alias("c"))))
    return _checkpoint(lists.select(*keys, newest["c"].alias("c")), keys)


def latest_restorable(payloads: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """What a job can restart from: ``latest.completed`` if it has a path, else the first completed
    entry of the history that has one; nulls without any. Adds ``external_path``.
    """
    d = payloads.select(*keys, F.from_json(column, CHECKPOINTS).alias("d"))
    history = F.filter("d.history", lambda h: h["status"] == "COMPLETED")
    listed = F.concat(F.array("d.latest.completed"), F.coalesce(history, F.slice(F.array("d.latest.completed"), 1, 0)))
    usable = F.filter(listed, lambda c: F.coalesce(c["external_path"] != "", F.lit(False)))
    picked = d.select(*keys, F.try_element_at(usable, F.lit(1)).alias("c"))
    return picked.select(
        *keys,
        F.col("c.id").alias("checkpoint_id"),
        F.col("c.end_to_end_duration").alias("duration_ms"),
        F.col("c.external_path").alias("external_path"),
    )


def checkpoint_records(rows: DataFrame, latest: str, details: str, keys: Sequence[str]) -> DataFrame:
    """One full record per row of JSON text: numbers from the details where there are some, else
    from the latest entry; ``keys`` identify a row.
    """
    v = F.try_parse_json(F.col(details))
    filled = F.coalesce(F.schema_of_variant(v).rlike("^OBJECT<.+>$"), F.lit(False))
    held = rows.select(
        *keys, F.col(latest).alias("_latest"), F.when(filled, F.col(details)).otherwise(F.col(latest)).alias("_source")
    )
    wanted = {
        "alignment_time_ms": (["alignment"], ["duration"]),
        "start_delay_ms": (["start", "delay"], []),
        "_buffered": (["alignment"], ["buffered"]),
    }
    # Expressions of a row, listed once: the numbers are read before anything asks for them.
    held = held.select("*", S.json_numbers(F.col("_source")).alias("_numbers"))
    held = held.select(*[c for c in held.columns if c != "_numbers"], *path_maxima("_numbers", wanted))
    entry, source = F.try_parse_json("_latest"), F.try_parse_json("_source")
    text = lambda doc, name: F.try_variant_get(doc, f"$.{name}", "string")
    number = lambda doc, name: S.to_float(text(doc, name))
    whole = lambda name: F.try_variant_get(entry, f"$.{name}", "bigint").alias(name)
    return held.select(
        *keys,
        F.try_variant_get(entry, "$.id", "bigint").alias("checkpoint_id"),
        text(entry, "status").alias("status"),
        whole("trigger_timestamp"),
        whole("latest_ack_timestamp"),
        F.coalesce(number(source, "end_to_end_duration"), number(entry, "end_to_end_duration")).alias("duration_ms"),
        "alignment_time_ms",
        F.coalesce("_buffered", number(entry, "alignment_buffered")).alias("alignment_buffered_bytes"),
        "start_delay_ms",
        number(entry, "checkpointed_size").alias("checkpointed_size_bytes"),
        number(entry, "processed_data").alias("processed_data_bytes"),
        number(entry, "persisted_data").alias("persisted_data_bytes"),
    )


def first_per_id(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Each id once, the first by ``order`` kept; pre-aggregated, unlike a sort per id."""
    others = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*others), order).alias("_r"))
        .select(*keys, "_r.*")
    )


def lag_series(
    arrivals: DataFrame, commits: DataFrame, job: str, bucket: str, event_id: str, width_seconds: int = SLICE
) -> DataFrame:
    """Lag at the end of every bucket: what has arrived by then and is not committed.

    Both inputs fold to one row per job and bucket before the shuffle, so the running totals
    see time steps, not events; they run slice by slice, so a job's steps never meet in one task.
    """
    fold = lambda df, side: df.groupBy(F.col(job).alias("job"), F.col(bucket).alias("bucket")).agg(
        F.count(F.lit(1)).alias(f"{side}_n"), F.max(event_id).alias(f"{side}_max")
    )
    steps = (
        fold(arrivals, "a")
        .unionByName(fold(commits, "c"), allowMissingColumns=True)
        .groupBy("job", "bucket")
        .agg(*[F.max(c).alias(c) for c in ("a_n", "a_max", "c_n", "c_max")])
    )
    steps = running(
        steps, "job", "bucket",
        {"a_sum": (F.col("a_n"), "sum"), "c_sum": (F.col("c_n"), "sum"), "a_top": (F.col("a_max"), "max"), "c_top": (F.col("c_max"), "max")},
        width_seconds,
    )
    zero = F.lit(0).cast("bigint")
    known = lambda c: F.coalesce(F.col(c), zero)
    return steps.select(
        "job",
        "bucket",
        known("a_top").alias("source_max_event_id"),
        known("c_top").alias("table_max_event_id"),
        F.greatest(known("a_top") - known("c_top"), zero).alias("max_event_id_gap"),
        known("a_sum").alias("source_rows"),
        known("c_sum").alias("changelog_rows"),
        F.greatest(known("a_sum") - known("c_sum"), zero).alias("lag_events"),
    )


def label_phases(
    series: DataFrame, baseline_samples: int, job: str = "job", time: str = "bucket", width_seconds: int = SLICE
) -> DataFrame:
    """Number the samples, label the first ones baseline and the rest by lag, add elapsed time."""
    numbered = running(series, job, time, {"_n": (F.lit(1), "sum"), "_first": (F.col(time), "min")}, width_seconds)
    phase = (
        F.when(F.col("_n") <= baseline_samples, BASELINE)
        .when(F.col("lag_events") > 0, LOADED)
        .otherwise(RECOVERY)
    )
    elapsed = S.floor_div(S.epoch_micros(F.col(time)) - S.epoch_micros(F.col("_first")), 1000)
    return numbered.select(
        *series.columns,
        (F.col("_n") - 1).cast("int").alias("sample_index"),
        elapsed.cast("bigint").alias("elapsed_ms"),
        phase.alias("phase"),
    )


def recovery_streak(
    series: DataFrame, job: str = "job", time: str = "bucket", needed: int = RECOVERED_AFTER, width_seconds: int = SLICE
) -> DataFrame:
    """Length of the current run of zero-lag samples, and where it first reaches ``needed``.

    The run is as long as the samples since the last one with lag, so numbers and their running
    maxima tell it, however many slices it spans.
    """
    scan = lambda df, values: running(df, job, time, values, width_seconds)
    lagging = F.col("lag_events") > 0
    rows = scan(series, {"_n": (F.lit(1), "sum")})
    rows = scan(rows, {"_last": (F.when(lagging, F.col("_n")), "max")})
    rows = rows.withColumn("streak", (F.col("_n") - F.coalesce("_last", F.lit(0))).cast("int"))
    # A run reaches the number once; the first run that does so decides.
    rows = scan(rows, {"_reached": (F.when(F.col("streak") == needed, F.col("_n")), "min")})
    return rows.select(*series.columns, "streak", F.coalesce(F.col("_reached") == F.col("_n"), F.lit(False)).alias("stops_here"))


def interval_max(
    samples: DataFrame,
    points: DataFrame,
    value: str,
    job: str = "job",
    time: str = "ts",
    width_seconds: int = 3600,
) -> DataFrame:
    """Per sample, count and largest ``value`` of the points since the sample before it.

    A point counts for the first sample of its job at or after it; points after the last sample
    count for none. Both inputs are read once, tagged and folded to one row per moment. Windows run
    per job and slice of ``width_seconds``; what a slice holds after its last sample is carried to
    the next slice that has one, so of a hot job only one row per slice meets in a task. Samples
    and points without a time are left out; copies of a sample stay copies.
    """
    t, own = S.epoch_micros(F.col(time)).alias("_t"), F.col(job).alias(job)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    seen = samples.select(own, t, one.alias("_copies"), zero.alias("_n"))
    dots = points.select(own, t, zero.alias("_copies"), one.alias("_n"), F.col(value).alias("_v"))
    folds = [F.sum("_copies").alias("_copies"), F.sum("_n").alias("_n"), F.max("_v").alias("_v")]
    moments = (
        seen.unionByName(dots, allowMissingColumns=True)
        .filter("_t is not null")
        .groupBy(job, "_t")
        .agg(*folds)
        .withColumn("_slice", S.floor_div(F.col("_t"), width_seconds * 1_000_000))
    )
    # Read backwards, the smallest sample so far is the next one.
    back = (
        Window.partitionBy(job, "_slice")
        .orderBy(F.desc("_t"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    at = F.min(F.when(F.col("_copies") > 0, F.col("_t"))).over(back)
    parts = moments.withColumn("_at", at).groupBy(job, "_slice", "_at").agg(*folds)
    tail = F.col("_at").isNull()
    later = (
        Window.partitionBy(job).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        parts.groupBy(job, "_slice")
        .agg(
            F.min("_at").alias("_first"),
            *[F.max(F.when(tail, F.col(c))).alias(c) for c in ("_copies", "_n", "_v")],
        )
        .select(job, F.min("_first").over(later).alias("_at"), "_copies", "_n", "_v")
        .filter("_n > 0")
    )
    return (
        parts.select(*carried.columns)
        .unionByName(carried)
        .filter("_at is not null")
        .groupBy(job, "_at")
        .agg(*folds)
        .withColumn("_copy", F.explode(F.sequence(one, F.col("_copies"))))
        .select(
            job,
            S.micros_to_timestamp(F.col("_at")).alias("sample_ts"),
            F.col("_n").alias("points"),
            F.col("_v").alias("max_value"),
        )
    )


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Recorded samples, one JSON document per line."""
    return spark.read.schema(SAMPLE).json(path)


def flat_samples(samples: DataFrame) -> DataFrame:
    """Nested sample documents to the columns the summary works on."""
    return samples.selectExpr(
        "sample_index",
        "phase",
        "checkpoint.duration_ms",
        "checkpoint.alignment_time_ms",
        "checkpoint.failed_count",
        "backpressure.indicator",
        "commit_lag.lag_events",
    )


def run_summary(
    samples: DataFrame, by: Sequence[str] = (), min_pressure: float = MIN_PRESSURE
) -> DataFrame:
    """Baseline against load in one pass, with the six checks and their baseline-relative forms.

    ``samples``: ``sample_index, phase, duration_ms, alignment_time_ms, failed_count, indicator,
    lag_events``.
    """
    base = F.col("phase") == BASELINE
    peak = lambda c, cond: F.max(F.when(cond, F.col(c)).cast("double"))
    s = samples.groupBy(*by).agg(
        peak("duration_ms", base).alias("baseline_max_duration_ms"),
        peak("alignment_time_ms", base).alias("baseline_max_alignment_ms"),
        peak("indicator", base).alias("baseline_max_indicator"),
        peak("failed_count", base).alias("baseline_max_failed"),
        peak("duration_ms", ~base).alias("load_max_duration_ms"),
        peak("alignment_time_ms", ~base).alias("load_max_alignment_ms"),
        peak("indicator", ~base).alias("load_max_indicator"),
        peak("indicator", F.col("phase") == LOADED).alias("pressure_phase_max_indicator"),
        peak("indicator", F.col("phase") == RECOVERY).alias("recovery_phase_max_indicator"),
        peak("lag_events", ~base).alias("load_max_lag_events"),
        F.max_by(
            F.col("lag_events").cast("double"),
            F.when(F.col("lag_events").isNotNull(), F.col("sample_index")),
        ).alias("final_lag_events"),
        F.max(F.col("failed_count").cast("double")).alias("failed_count_peak"),
    )
    nz = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rose = lambda a, b: F.coalesce(F.col(b) > F.col(a), F.lit(False))
    checks = {
        "duration_rose": rose("baseline_max_duration_ms", "load_max_duration_ms"),
        "alignment_rose": rose("baseline_max_alignment_ms", "load_max_alignment_ms"),
        "failure_count_recorded": F.col("failed_count_peak").isNotNull(),
        "pressure_observed": nz("load_max_indicator") >= min_pressure,
        "lag_observed": nz("load_max_lag_events") > 0.0,
        "lag_recovered": F.coalesce(F.col("final_lag_events") == 0.0, F.lit(False)),
    }
    for name, cond in checks.items():
        s = s.withColumn(name, cond)
    all_pass = F.lit(True)
    for name in checks:
        all_pass = all_pass & F.col(name)
    return (
        s.withColumn("passed", all_pass)
        .withColumn("pressure_rose", rose("baseline_max_indicator", "load_max_indicator"))
        .withColumn("failures_rose", rose("baseline_max_failed", "failed_count_peak"))
    )


def merged_sample(columns: dict[str, Sequence[str]], how: str) -> dict[str, Column]:
    """Several readings of one quantity to one: the largest, or the first that is there."""
    pick = {"max": F.greatest, "first": F.coalesce}[how]
    out = {}
    for name, parts in columns.items():
        values = [S.to_float(F.col(p)) for p in parts]
        out[name] = (values[0] if len(values) == 1 else pick(*values)).alias(name)
    return out
