from __future__ import annotations

import json
import random
import re
from datetime import datetime, timedelta

import pytest
from conftest import rows
from pyspark.errors import PySparkException

from changeflow.operators import runmetrics as M

T0 = datetime(2026, 1, 1)

LINES = """
# HELP ignored ignored
engine_job_lastCheckpointDuration{job_id="abc",job_name="cdc"} 42
engine_task_backPressuredTimeMsPerSecond{job_id="abc"} 250.5
no value here
engine_plain 1e3 1700000000
"""


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.splitlines()], "value string")


def test_metric_lines(spark):
    got = rows(M.metric_lines(lines(spark, LINES)))
    assert got == [
        ("engine_job_lastCheckpointDuration", {"job_id": "abc", "job_name": "cdc"}, 42.0),
        ("engine_plain", {}, 1000.0),
        ("engine_task_backPressuredTimeMsPerSecond", {"job_id": "abc"}, 250.5),
    ]


def test_lines_of_the_text_format(spark):
    text = "\n".join([
        r'a{l="x},y",m="q\"\\\n"} 1',
        "b NaN",
        "c{} +Inf -5",
        "d -2.5e-3",
        "e 1 2 3",
        "f{l=x} 1",
    ])
    got = {r["name"]: r for r in M.metric_lines(lines(spark, text)).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert got["a"]["labels"] == {"l": "x},y", "m": 'q"\\\n'}
    assert got["b"]["value"] != got["b"]["value"] and got["c"]["value"] == float("inf") and got["d"]["value"] == -0.0025


def test_reporter_snapshot_of_one_job(spark):
    text = "\n".join([
        'engine_job_lastCheckpointDuration{job_id="other"} 900',
        'engine_job_lastCheckpointDuration{job_id="abc"} 110',
        "engine_job_numberOfFailedCheckpoints 0",
        'engine_task_backPressuredTimeMsPerSecond{job="abc",task="slow"} 0',
        'engine_task_busyTimeMsPerSecond{job_id="abc"} 620',
        'engine_task_checkpointAlignmentTime{job_id="abc"} 2500000',
    ])
    metrics = M.job_metrics(M.metric_lines(lines(spark, text)), "abc")
    snap = M.reporter_snapshot(metrics).first()
    assert snap["checkpoint_duration_ms"] == 110.0
    assert snap["checkpoint_duration_ms_name"].endswith("lastCheckpointDuration")
    assert snap["checkpoint_alignment_time_ms"] == 2.5
    assert snap["checkpoint_failed_count"] == 0.0
    assert snap["pressure_indicator"] == 0.62
    assert snap["is_backpressured"] is None and snap["is_backpressured_name"] is None


def series(spark, lags, job="j"):
    data = [(job, T0 + timedelta(hours=i), lag) for i, lag in enumerate(lags)]
    return spark.createDataFrame(data, "job string, bucket timestamp_ntz, lag_events bigint")


def test_recovery_streak(spark):
    out = M.recovery_streak(series(spark, [5, 0, 0, 4, 0, 0, 0, 0, 1, 0, 0, 0])).orderBy("bucket").collect()
    assert [r["streak"] for r in out] == [0, 1, 2, 0, 1, 2, 3, 4, 0, 1, 2, 3]
    assert [i for i, r in enumerate(out) if r["stops_here"]] == [6]


def test_a_hot_job_is_scanned_slice_by_slice(spark):
    rng = random.Random(5)
    lags = [rng.choice([0, 0, 0, 2]) for _ in range(300)] + [0] * 270 + [1] + [0] * 30
    df = series(spark, lags).unionByName(series(spark, [3, 0, 0, 0], None))
    for width in (3 * 3600, 10**9):
        out = M.recovery_streak(df, width_seconds=width).where("job = 'j'").orderBy("bucket").collect()
        run, want = 0, []
        for lag in lags:
            run = 0 if lag else run + 1
            want.append(run)
        assert [r["streak"] for r in out] == want
        assert [i for i, r in enumerate(out) if r["stops_here"]] == [want.index(3)]
        out = M.label_phases(df, 3, width_seconds=width).where("job = 'j'").orderBy("bucket").collect()
        assert [r["sample_index"] for r in out] == list(range(601)) and out[-1]["elapsed_ms"] == 600 * 3_600_000
        alone = M.recovery_streak(df, width_seconds=width).where("job IS NULL").orderBy("bucket").collect()
        assert [(r["streak"], r["stops_here"]) for r in alone] == [(0, False), (1, False), (2, False), (3, True)]
    text = M.recovery_streak(df)._jdf.queryExecution().executedPlan().toString()
    # Windows of one job alone run over slices, never over samples.
    for line in text.splitlines():
        if "Window [" in line:
            assert re.search(r"windowspecdefinition\(job#\d+, _slice#\d+", line) or "windowspecdefinition(_key#" in line


def test_phases(spark):
    out = M.label_phases(series(spark, [0, 0, 7, 3, 0]), 3).orderBy("bucket").collect()
    assert [r["phase"] for r in out] == ["baseline"] * 3 + ["backpressure", "recovery"]
    assert [r["sample_index"] for r in out] == [0, 1, 2, 3, 4]
    assert out[4]["elapsed_ms"] == 4 * 3_600_000


SAMPLES = (
    "sample_index int, phase string, duration_ms double, alignment_time_ms double, "
    "failed_count double, indicator double, lag_events bigint"
)


def summary(spark, samples):
    return M.run_summary(spark.createDataFrame(samples, SAMPLES)).first()


def test_run_summary(spark):
    good = [
        (0, "baseline", 20.0, 1.0, 0.0, 0.0, 0),
        (1, "backpressure", 120.0, 18.0, 0.0, 0.3, 50),
        (2, "recovery", 55.0, 2.0, 0.0, 0.0, 0),
    ]
    s = summary(spark, good)
    assert s["passed"] and s["load_max_duration_ms"] == 120 and s["load_max_alignment_ms"] == 18
    assert s["final_lag_events"] == 0 and s["pressure_rose"] and not s["failures_rose"]
    assert (s["pressure_phase_max_indicator"], s["recovery_phase_max_indicator"]) == (0.3, 0.0)
    same = [(0, "baseline", 120.0, 1.0, 0.0, 0.0, 0), *good[1:]]
    assert not summary(spark, same)["duration_rose"]  # equal is no rise
    nothing = [(0, "baseline", None, 1.0, None, 0.5, 0), (1, "backpressure", 9.0, 2.0, None, 0.3, None)]
    s = summary(spark, nothing)
    assert not s["duration_rose"] and not s["failure_count_recorded"] and not s["lag_observed"]
    assert s["pressure_observed"] and not s["pressure_rose"]
    assert s["final_lag_events"] == 0  # the last sample that has a lag
    assert not s["passed"]


@pytest.mark.parametrize("width", [1, 1000, 1_000_000])
def test_interval_max_against_brute_force(spark, width):
    rng = random.Random(5)
    points = [("j" if rng.random() < 0.5 else "k", T0 + timedelta(seconds=rng.randrange(50_000)), float(i)) for i in range(300)]
    samples = sorted({("j", T0 + timedelta(seconds=rng.randrange(60_000))) for _ in range(12)})
    samples += [("k", T0 + timedelta(seconds=40_000)), ("empty", T0)]
    got = M.interval_max(
        spark.createDataFrame(samples, "job string, ts timestamp_ntz"),
        spark.createDataFrame(points, "job string, ts timestamp_ntz, v double"),
        "v",
        width_seconds=width,
    )
    want = []
    for job, at in samples:
        before = max((t for j, t in samples if j == job and t < at), default=datetime.min)
        inside = [v for j, t, v in points if j == job and before < t <= at]
        want.append((job, at, max(inside, default=None), len(inside)))
    assert rows(got, "job", "sample_ts", "max_value", "points") == sorted(want, key=str)


def test_lag_series_counts_what_is_not_committed(spark):
    schema = "job string, bucket timestamp_ntz, event_id bigint"
    at = lambda h: T0 + timedelta(hours=h)
    arrived = spark.createDataFrame([("j", at(0), 1), ("j", at(1), 2), ("j", at(1), 3)], schema)
    done = spark.createDataFrame([("j", at(0), 1), ("j", at(4), 2), ("j", at(4), 3)], schema)
    out = M.lag_series(arrived, done, "job", "bucket", "event_id").orderBy("bucket").collect()
    assert [(r["source_rows"], r["changelog_rows"], r["lag_events"], r["max_event_id_gap"]) for r in out] == [
        (1, 1, 0, 0), (3, 1, 2, 2), (3, 3, 0, 0),
    ]


PAYLOAD = {
    "counts": {"failed": 1},
    "latest": {"completed": {"id": 7, "status": "COMPLETED", "end_to_end_duration": 55}},
    "history": [
        {"id": 8, "status": "IN_PROGRESS"},
        {"id": 7, "status": "COMPLETED", "end_to_end_duration": 99},
        {"id": 6, "status": "FAILED", "end_to_end_duration": 12},
        {"id": 5, "status": "COMPLETED", "end_to_end_duration": 40},
    ],
}


def test_checkpoint_history(spark):
    without = {**PAYLOAD, "latest": {"completed": None}}
    docs = [("a", json.dumps(PAYLOAD)), ("b", json.dumps(without)), ("c", '{"history": []}'), ("d", "{}")]
    df = spark.createDataFrame(docs, "k string, doc string")
    assert rows(M.completed_checkpoints(df, "doc", ["k"])) == [
        ("a", 5, 40.0), ("a", 7, 55.0), ("b", 5, 40.0), ("b", 7, 99.0),
    ]
    assert rows(M.latest_completed(df, "doc", ["k"])) == [
        ("a", 7, 55.0), ("b", 7, 99.0), ("c", None, None), ("d", None, None),
    ]


def test_numbers_in_nested_json(spark):
    doc = {"tasks": {"t1": {"subtasks": [{"alignment": {"duration": 3, "buffered": 9}}, {"alignment": {"duration": "8.5"}}]}},
           "alignment_duration": True, "start": {"delay": 2}, "e": {}, "l": [], "n": None}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "broken"), (3, "5")], "k int, doc string")
    leaves = M.numeric_leaves(df, "doc", ["k"], 6).cache()
    assert rows(leaves.filter("k = 1"), "path", "number") == [
        ("start.delay", 2.0),
        ("tasks.t1.subtasks.0.alignment.buffered", 9.0),
        ("tasks.t1.subtasks.0.alignment.duration", 3.0),
        ("tasks.t1.subtasks.1.alignment.duration", 8.5),
    ]
    assert rows(leaves.filter("k = 3"), "path", "number") == [("", 5.0)]
    wanted = {"a": (["alignment"], ["duration"]), "d": (["start", "delay"], []), "none": (["x"], [])}
    assert rows(M.path_max(leaves.filter("k = 1"), ["k"], wanted)) == [(1, 8.5, 2.0, None)]
    deep = spark.createDataFrame([(1, "[" * 20 + "7" + "]" * 20), (2, '{"a": "}]]", "b": 1}')], "k int, doc string")
    assert rows(M.numeric_leaves(deep, "doc", ["k"]), "k", "number") == [(1, 7.0), (2, 1.0)]
    assert rows(M.numeric_leaves(deep, "doc", ["k"]), "path") == [("0" + ".0" * 19,), ("b",)]
    long = json.dumps({"a": [{"b": i, "c\"d, ]}": [i]} for i in range(500)], "é": {"": -1.5e3}})
    leaves = M.numeric_leaves(spark.createDataFrame([(1, long), (2, None), (3, "{}")], "k int, doc string"), "doc", ["k"])
    want = [("é.", -1500.0)] + [x for i in range(500) for x in ((f"a.{i}.b", float(i)), (f'a.{i}.c"d, ]}}.0', float(i)))]
    assert rows(leaves, "path", "number") == sorted(want, key=str)
    with pytest.raises(PySparkException, match="too deep"):
        M.numeric_leaves(df, "doc", ["k"], 3).collect()


def test_merged_samples(spark):
    df = spark.createDataFrame([(None, "7.5", 3.0), (None, None, None)], "a double, b string, c double")
    out = df.select(
        M.merged_sample({"top": ["a", "b", "c"]}, "max")["top"],
        M.merged_sample({"lead": ["a", "c", "b"]}, "first")["lead"],
    )
    assert rows(out) == [(7.5, 3.0), (None, None)]


def test_first_per_id(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, "only")], "id string, at int, v string")
    assert rows(M.first_per_id(df, ["id"], "at"), "id", "v") == [("a", "early"), ("b", "only")]


def test_recorded_samples(spark, tmp_path):
    lag = [0, 9, 0]
    docs = [
        {
            "sample_index": i, "phase": phase, "elapsed_ms": i * 1000,
            "checkpoint": {"duration_ms": 20 + 100 * i, "alignment_time_ms": i, "failed_count": 0},
            "backpressure": {"indicator": i / 10}, "commit_lag": {"lag_events": lag[i]},
        }
        for i, phase in enumerate(("baseline", "backpressure", "recovery"))
    ]
    path = tmp_path / "samples.json"
    path.write_text("\n".join(json.dumps(d) for d in docs))
    s = M.run_summary(M.flat_samples(M.read_samples(spark, str(path)))).first()
    assert s["passed"] and s["load_max_lag_events"] == 9 and s["load_max_duration_ms"] == 220


def test_interval_max_of_copies_and_missing_times(spark):
    s = spark.createDataFrame([("j", T0), ("j", T0), ("j", None)], "job string, ts timestamp_ntz")
    early = T0 - timedelta(days=400)
    p = spark.createDataFrame(
        [("j", early, 4.0), ("j", T0, None), ("j", None, 9.0), ("j", T0 + timedelta(seconds=1), 8.0)],
        "job string, ts timestamp_ntz, v double",
    )
    assert rows(M.interval_max(s, p, "v")) == [("j", T0, 2, 4.0)] * 2
    assert M.interval_max(s.limit(0), p, "v").count() == 0
    assert rows(M.interval_max(s, p.limit(0), "v")) == [("j", T0, 0, None)] * 2
