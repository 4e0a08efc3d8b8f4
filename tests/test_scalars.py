from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeflow.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numbers_become_times(spark):
    at = lambda v, unit=None: one(spark, S.number_to_timestamp(F.lit(v).cast("bigint"), unit))
    assert at(1767225601000) == datetime(2026, 1, 1, 0, 0, 1)
    assert at(1767225601000123) == datetime(2026, 1, 1, 0, 0, 1, 123)
    assert at(-1) == datetime(1969, 12, 31, 23, 59, 59, 999000)
    assert at(-1, "us") == datetime(1969, 12, 31, 23, 59, 59, 999999)
    # below the threshold a number is milliseconds even if microseconds were meant; unit= decides
    assert at(99_999_999_999_999) == datetime(5138, 11, 16, 9, 46, 39, 999000)
    assert at(99_999_999_999_999, "us") == datetime(1973, 3, 3, 9, 46, 39, 999999)
    assert at(100_000_000_000_000) == datetime(1973, 3, 3, 9, 46, 40)
    with pytest.raises(ValueError):
        S.number_to_timestamp(F.lit(1), "s")


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2026-01-02T00:00:01Z", datetime(2026, 1, 2, 0, 0, 1)),
        ("2026-01-02T00:00:01.123456789Z", datetime(2026, 1, 2, 0, 0, 1, 123456)),
        ("2026-01-02 00:00:01", datetime(2026, 1, 2, 0, 0, 1)),
        ("2026-01-02T00:00:01", datetime(2026, 1, 2, 0, 0, 1)),
        ("2026-01-02 00:00:01.1", datetime(2026, 1, 2, 0, 0, 1, 100000)),
        ("2026-01-02 00:00:01.123456", datetime(2026, 1, 2, 0, 0, 1, 123456)),
        ("1767225601000", datetime(2026, 1, 1, 0, 0, 1)),
        ("-1", datetime(1969, 12, 31, 23, 59, 59, 999000)),
        ("2026-01-02T00:00:01+02:00", None),
        ("2026-01-02", None),
        ("2026-13-02 00:00:01", None),
        ("soon", None),
        ("", None),
    ],
)
def test_text_becomes_time(spark, text, expected):
    assert one(spark, S.text_to_timestamp(F.lit(text))) == expected


def test_times_do_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, S.text_to_timestamp(F.lit("2026-01-02T00:00:01Z"))) == datetime(2026, 1, 2, 0, 0, 1)
        assert one(spark, S.epoch_micros(F.expr("TIMESTAMP_NTZ'2026-01-01 00:00:01'"))) == 1767225601000000
        stamp = F.expr("TIMESTAMP'2026-01-01 00:00:01+00:00'")
        assert one(spark, S.coerce_timestamp(stamp, T.TimestampType())) == datetime(2026, 1, 1, 0, 0, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "text, expected",
    [
        ("12", 12), ("-7", -7), ("12.9", 12), ("-12.9", -12), ("1e3", 1000),
        ("9223372036854775807", 9223372036854775807), ("9223372036854775808", None),
        ("abc", None), ("", None), ("1 2", None),
    ],
)
def test_any_number_text_to_long(spark, text, expected):
    assert one(spark, S.text_to_long(F.lit(text))) == expected


def test_whole_numbers_of_other_types(spark):
    assert one(spark, S.coerce_whole(F.lit(12.7), T.DoubleType(), "bigint")) == 12
    assert one(spark, S.coerce_whole(F.lit(3_000_000_000), T.LongType(), "int")) is None
    with pytest.raises(TypeError):
        S.coerce_whole(F.lit(True), T.BooleanType(), "int")


def test_padded_key_never_cuts(spark):
    assert one(spark, S.padded_key("order-", F.lit(7))) == "order-000000000007"
    assert one(spark, S.padded_key("o-", F.lit(1234567890123456))) == "o-1234567890123456"


def test_time_text_is_cut_not_rounded(spark):
    assert one(spark, S.ms_text(F.expr("TIMESTAMP_NTZ'2026-01-02 00:00:01.1239'"))) == "2026-01-02 00:00:01.123"
    for text, expected in [("a.1", "a.100"), ("a.123999", "a.123"), ("a", "a.000")]:
        assert one(spark, S.ms_text_from_text(F.lit(text))) == expected


@pytest.mark.parametrize(
    "explicit, flag, busy, expected",
    [
        (250.0, None, 900.0, 0.25),
        (0.0, 1.0, None, 1.0),
        (0.0, 0.0, 620.0, 0.62),
        (1500.0, None, None, 1.0),
        (0.0, None, None, 0.0),
        (None, 0.0, None, 0.0),
        (None, None, 300.0, 0.3),
        (-5.0, None, 2000.0, 1.0),
        (None, None, None, None),
    ],
)
def test_pressure_indicator(spark, explicit, flag, busy, expected):
    d = lambda v: F.lit(v).cast("double")
    assert one(spark, S.pressure_indicator(d(explicit), d(flag), d(busy))) == expected


def test_labels(spark):
    raw = r'job_id="abc", name="a\"b" ,odd,x="1",x="2"'
    assert one(spark, S.labels_map(F.lit(raw))) == {"job_id": "abc", "name": 'a"b', "x": "2"}
    assert one(spark, S.labels_map(F.lit(""))) == {}


def test_paths_and_numbers(spark):
    assert one(spark, S.state_path(F.lit("file:/a/b"))) == "file:///a/b"
    assert one(spark, S.state_path(F.lit("file:///a/b"))) == "file:///a/b"
    assert one(spark, S.state_path(F.lit("s3://a/b"))) == "s3://a/b"
    for path, n in [("/x/chk-12", 12), ("chk-3 ", 3), ("/x/chk-a", None), ("/x/chk-1/y", None)]:
        assert one(spark, S.checkpoint_number(F.lit(path))) == n


def test_last_json_object(spark):
    text = 'log\n{"a": 1}\nnoise\n{"b": 2}\nend'
    assert one(spark, S.last_json_object(F.lit(text))) == '{"b": 2}'
    assert one(spark, S.last_json_object(F.lit('x {"c": 3} y'))) == '{"c": 3}'
    assert one(spark, S.last_json_object(F.lit("none"))) is None


def test_small_helpers(spark):
    summary = F.create_map(F.lit("a"), F.lit("3"), F.lit("b"), F.lit(None))
    assert one(spark, S.summary_int(summary, "a")) == 3
    assert one(spark, S.summary_int(summary, "b")) == 0
    assert one(spark, S.summary_int(summary, "c")) == 0
    assert one(spark, S.to_float(F.lit("2.5"))) == 2.5
    assert one(spark, S.to_float(F.lit(True))) is None
    assert one(spark, S.metric_key(F.lit("Engine_job.Last-1"))) == "enginejoblast1"
    ns = S.alignment_ms(F.lit(2_500_000.0), F.lit("x_checkpointAlignmentTime"))
    assert one(spark, ns) == 2.5
    assert one(spark, S.alignment_ms(F.lit(7.0), F.lit("x_alignmentDuration"))) == 7.0
