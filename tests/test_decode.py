from __future__ import annotations

import json
from datetime import datetime

import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from changeflow.operators import decode as D
from changeflow.operators import state
from changeflow.schemas import CHANGE_COLUMNS, CHANGELOG_COLUMNS, ENVELOPE, TEXT_ENVELOPE
from changeflow.streaming.ingest import json_envelopes, value_envelopes


def image(order_id=1, event_id=11, amount=500, at=1767225601000, **extra):
    base = {
        "order_id": order_id, "business_key": f"k{order_id}", "event_id": event_id, "customer_id": 9,
        "status": "created", "amount_cents": amount, "updated_at": at, "seed": 1,
    }
    return {**base, **extra}


def env(op, pos, before=None, after=None, source=True, ts_ms=77, file=None, row=0):
    e = {"op": op, "ts_ms": ts_ms, "before": before, "after": after}
    if source:
        e["source"] = {"pos": pos, "row": row, **({"file": file} if file else {})}
    return e


def load(spark, tmp_path, lines, schema=ENVELOPE):
    path = tmp_path / "in.json"
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return json_envelopes(spark, str(path), schema)


KIND = ("cdc_row_kind", "cdc_operation", "event_id", "_seq", "_img")


def test_one_envelope_gives_zero_one_or_two_rows(spark, tmp_path):
    df = load(spark, tmp_path, [
        env("r", 0, after=image(1, 10)),
        env("c", 1, after=image(2, 11)),
        env("u", 2, before=image(2, 11), after=image(2, 12)),
        env("d", 3, before=image(2, 12)),
        env("x", 4, source=False),
    ])
    out = D.decode(df)
    assert out.columns == CHANGE_COLUMNS
    assert rows(out, *KIND) == sorted([
        ("+I", "snapshot", 10, 0, 1),
        ("+I", "insert", 11, 1, 1),
        ("-U", "update_before", 11, 2, 0),
        ("+U", "update_after", 12, 2, 1),
        ("-D", "delete", 12, 3, 0),
    ], key=str)
    first = out.filter("event_id = 10").first()
    assert first["updated_at"] == datetime(2026, 1, 1, 0, 0, 1)
    assert first["source_ts_ms"] == 77  # the envelope's own time
    assert D.audit_rows(out).columns == CHANGELOG_COLUMNS
    assert D.drop_update_before(out).filter("cdc_row_kind = '-U'").count() == 0
    assert D.current_rows(out).columns[-1] == "cdc_row_kind"
    assert rows(D.rejects(df)) == []


BAD = [
    (env("u", 1, after=image()), "missing before image"),
    (env("u", 1, before=image()), "missing after image"),
    (env("d", 1), "missing before image"),
    (env("c", 1, before=image()), "missing after image"),
    (env("x", 1, after=image()), "unsupported operation x"),
    ({"op": None, "source": {"pos": 1}}, "unsupported operation"),
    (env("c", 1, after=image(amount="many")), "bad amount_cents in after"),
    (env("c", 1, after=image(amount=None)), "bad amount_cents in after"),
    (env("c", 1, after=image(at="soon")), "bad updated_at in after"),
    (env("c", 1, after=image(status=None)), "bad status in after"),
    (env("u", 1, before=image(seed=2**40), after=image()), "bad seed in before"),
    (env("c", None, after=image()), "no usable log position"),
    (env("c", 1, after=image(), file="log.000001", row=-1), "no usable log position"),
    (env("c", 1, after=image(), file="log"), "no usable log position"),
    ("{not json", "malformed record"),
]


@pytest.mark.parametrize("bad, reason", BAD, ids=[r + str(i) for i, (_, r) in enumerate(BAD)])
def test_bad_envelopes_are_named_or_stop_the_job(spark, tmp_path, bad, reason):
    df = load(spark, tmp_path, [env("c", 0, after=image(5, 50)), bad]).cache()
    assert rows(D.rejects(df), "reject_reason") == [(reason,)]
    assert rows(D.decode(df), "event_id") == [(50,)]
    assert rows(D.decode_upserts(df), "event_id") == [(50,)]
    with pytest.raises(PySparkException):
        D.decode(df, mode="fail").collect()


def test_rejects_keep_the_record_as_it_came(spark, tmp_path):
    line = json.dumps(env("c", 1, after=image(amount="many")))
    df = load(spark, tmp_path, [line, env("u", 2, after=image(3, 30))]).cache()
    kept = {r["reject_reason"]: json.loads(r["raw"]) for r in D.rejects(df).collect()}
    assert kept["bad amount_cents in after"]["after"]["amount_cents"] == "many"
    assert kept["missing before image"]["after"]["order_id"] == 3


def test_values_that_are_no_records_are_skipped(spark, tmp_path):
    df = load(spark, tmp_path, ["null", "5", '"text"', env("c", 0, after=image(5, 50)), '{"op": "x"']).cache()
    assert rows(D.decode(df), "event_id") == [(50,)]
    assert rows(D.rejects(df), "reject_reason", "raw") == [("malformed record", '{"op": "x"')]
    assert df.filter(D.is_ignored(df)).count() == 3


def test_fail_mode_lets_good_and_stray_values_pass(spark, tmp_path):
    df = load(spark, tmp_path, [env("c", 0, after=image(5, 50)), env("x", 4, source=False)])
    assert rows(D.decode(df, mode="fail"), "event_id") == [(50,)]
    with pytest.raises(ValueError):
        D.decode(df, mode="lenient")


def test_text_images_are_narrowed(spark, tmp_path):
    good = image("7", "70", "12.9", "2026-01-02T00:00:01Z", seed="3")
    df = load(spark, tmp_path, [env("c", 0, after=good), env("c", 1, after=image(amount="x"))], TEXT_ENVELOPE)
    row = D.decode(df).first()
    assert (row["order_id"], row["amount_cents"], row["seed"]) == (7, 12, 3)
    assert row["updated_at"] == datetime(2026, 1, 2, 0, 0, 1)
    assert rows(D.rejects(df), "reject_reason") == [("bad amount_cents in after",)]


def test_message_values(spark):
    good = json.dumps(env("c", 0, after=image(5, 50)))
    messages = spark.createDataFrame([(good.encode(),), (None,), (b"{broken",)], "value binary")
    df = value_envelopes(messages)
    assert rows(D.decode(df), "event_id") == [(50,)]
    assert rows(D.rejects(df), "reject_reason") == [("malformed record",)]


def test_log_positions_are_ordered_across_files_and_rows(spark, tmp_path):
    places = [
        ("log.000001", 4, 0), ("log.000001", 4, 1), ("log.000001", 4, 5000), ("log.000001", 900, 0),
        ("log.000001", 5 * 10**9, 0), ("log.000002", 4, 0), ("log.000010", 4, 0), ("log.600000", 3, 0),
        (f"log.{2**62}", 2**62, 2**31 - 1),
    ]
    df = load(spark, tmp_path, [env("c", p, after=image(i, i), file=f, row=r) for i, (f, p, r) in enumerate(places)])
    got = [r["event_id"] for r in D.decode(df).orderBy("_file", "_seq", "_row").collect()]
    assert got == list(range(len(places))) and rows(D.rejects(df)) == []
    of_one_key = D.decode(df).withColumn("order_id", F.lit(1).cast("bigint"))
    assert rows(state.current_state(of_one_key), "event_id") == [(len(places) - 1,)]
    data, deletes = state.upsert_files(of_one_key)
    assert rows(state.apply_equality_deletes(data, deletes), "event_id") == [(len(places) - 1,)]
    assert rows(state.position_conflicts(D.decode(df))) == []
    twice = D.decode(df).unionByName(D.decode(df).filter("event_id = 2"))
    assert rows(state.position_conflicts(twice), "order_id", "copies") == [(2, 2)]


def test_a_moved_key(spark, tmp_path):
    df = load(spark, tmp_path, [
        env("c", 0, after=image(1, 10)),
        env("u", 1, before=image(1, 10), after=image(2, 11)),
    ])
    current = lambda mode: rows(state.current_state(D.decode_upserts(df, rekey=mode)), "order_id")
    assert current("reference") == [(1,), (2,)]
    assert current("strict") == [(2,)]
    with pytest.raises(ValueError):
        D.decode_upserts(df, rekey="maybe")
