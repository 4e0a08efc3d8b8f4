from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from changeflow.functions.ranks import dense_positions
from changeflow.operators import decode as D
from changeflow.operators import state
from changeflow.schemas import CURRENT_COLUMNS
from changeflow.sources import feeds, readers, sqltext, statements
from changeflow.streaming.table import ChangeTable


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_positions_are_dense(spark, width):
    ids = random.Random(1).sample(range(-200, 10_000), 150)
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(5)
    got = dense_positions(df, "id", "pos", width).orderBy("id").collect()
    assert [r["pos"] for r in got] == list(range(150))


@pytest.mark.parametrize("width", [1, 1000, 1 << 20])
def test_positions_of_sparse_numbers(spark, width):
    rng = random.Random(2)
    # far apart, in clusters, negative, and at the ends of what a whole number holds
    ids = {rng.randrange(-(1 << 62), 1 << 62) for _ in range(60)}
    ids |= {(1 << 40) + i for i in range(30)} | {-(1 << 50) - i for i in range(30)} | {0, (1 << 63) - 1}
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(5)
    got = dense_positions(df, "id", "pos", width).collect()
    assert {r["id"]: r["pos"] for r in got} == {v: n for n, v in enumerate(sorted(ids))}


def test_sizes_of_ranges_do_not_meet_in_one_task(spark):
    # every number is a range of its own; what meets last is ranges of 2^16 ranges of 2^16 ranges
    df = spark.range(2000).selectExpr("id * 4194304 AS id")
    plan = dense_positions(df, "id", "pos")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = [i for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert len(at) == 1
    below = lines[at[0] + 1 : at[0] + 8]
    assert sum("HashAggregate" in line for line in below) >= 2
    assert dense_positions(df, "id", "pos").filter("pos * 4194304 <> id").count() == 0


def test_statements_change_the_table(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t")).create()
    orders = feeds.seeded_orders(spark, 20, 1)
    table.append_envelopes(statements.insert(orders, first_seq=1), "sql", 0)
    assert rows(table.current()) == rows(orders)

    paid = statements.update(
        table.current(), F.col("order_id") <= 5,
        {"status": F.lit("paid"), "event_id": F.col("event_id") + 1000}, first_seq=21,
    )
    table.append_envelopes(paid, "sql", 1)
    assert table.current().filter("status = 'paid' and event_id > 1000").count() == 5
    assert table.changelog().groupBy("cdc_operation").count().filter("cdc_operation = 'update_before'").first()["count"] == 5

    table.append_envelopes(statements.delete(table.current(), F.col("order_id") == 3, first_seq=26), "sql", 2)
    assert table.current().count() == 19
    table.append_envelopes(statements.truncate(table.current(), first_seq=27), "sql", 3)
    assert table.current().count() == 0
    assert state.position_conflicts(table.committed_changes()).count() == 0
    with pytest.raises(ValueError, match="no such column"):
        statements.update(orders, F.lit(True), {"colour": F.lit(1)}, 0)


def test_statement_positions_follow_the_key(spark):
    orders = feeds.seeded_orders(spark, 10, 1).repartition(4)
    changes = D.decode(statements.insert(orders, first_seq=100))
    assert rows(changes.select("order_id", (F.col("_seq") - 99).alias("n")).filter("order_id <> n")) == []


def test_readers(spark, tmp_path):
    path = str(tmp_path / "source")
    feeds.write_orders(feeds.seeded_orders(spark, 10, 1), path)
    assert readers.source_rows(spark, path).count() == 10
    assert readers.stored_table(spark, path).columns == readers.source_rows(spark, path).columns
    (tmp_path / "scrape.txt").write_text("a 1\nb 2\n")
    assert readers.reporter_text(spark, str(tmp_path / "scrape.txt")).count() == 2


def test_statements_as_text(spark, tmp_path):
    def one(text, **more):
        return D.decode(sqltext.envelopes_of(spark, text, **more))

    six = feeds.sequence_orders(spark.range(6), "id", base_event_id=10, prefix="t", customer_base=1, amount_base=5, seed=3)
    base = D.decode(statements.insert(six, first_seq=0))
    state.current_state(base).createOrReplaceTempView("t")
    ids = [r["order_id"] for r in spark.table("t").orderBy("order_id").collect()]
    out = one("UPDATE t x SET x.status = concat(status, '!'), seed = '9' WHERE x.order_id IN (SELECT max(order_id) FROM t)")
    assert rows(out, "cdc_row_kind", "order_id", "seed")[0] == ("+U", ids[-1], 9) and out.count() == 2
    assert one("UPDATE t SET seed = seed + 1").count() == 12
    assert rows(one("DELETE FROM t WHERE order_id < 0")) == []
    assert rows(one("TRUNCATE TABLE t", first_seq=5, file="log.7"), "_file", "_seq") == sorted(((7, 5 + i) for i in range(6)), key=str)
    short = sqltext.envelopes_of(spark, "INSERT INTO t (order_id, status) VALUES (1, 'new')")
    assert rows(D.rejects(short), "reject_reason") == [("bad business_key in after",)]
    bad = ["INSERT INTO t (order_id) VALUES (1, 2)", "INSERT OVERWRITE t SELECT * FROM t", "UPDATE t SET colour = 1",
           "SELECT 1", "INSERT INTO t (nothing) VALUES (1)"]
    for text in bad:
        with pytest.raises(ValueError):
            sqltext.envelopes_of(spark, text)
    with pytest.raises(ParseException):
        sqltext.envelopes_of(spark, "DELETE t WHERE")
    script = ["DELETE FROM t WHERE order_id = " + str(ids[0]), "UPDATE t SET status = 'left'", "INSERT INTO t SELECT order_id - 1000000, "
              "business_key, event_id, customer_id, status, amount_cents, updated_at, seed FROM t WHERE order_id = " + str(ids[1])]
    made = D.decode(sqltext.run_script(spark, script, "t"))
    assert rows(made.groupBy("_file", "cdc_row_kind").count()) == [(1, "-D", 1), (2, "+U", 5), (2, "-U", 5), (3, "+I", 1)]
    assert rows(spark.table("t"), "status") == [("left",)] * 6
    spark.catalog.dropTempView("t")
