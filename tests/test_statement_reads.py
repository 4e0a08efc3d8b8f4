from __future__ import annotations

from pathlib import Path

from changeflow.functions.ranks import dense_positions
from changeflow.plans import queries
from changeflow.sources import sqltext


def test_a_script_reads_its_table_from_storage(spark, sf, tmp_path, monkeypatch):
    home = str(tmp_path / "script")
    monkeypatch.setattr(sqltext, "run_dir", lambda *a: home)
    before = queries.orders_current(spark, sf)
    before.createOrReplaceTempView("orders_read_once")
    sqltext.run_script(spark, ["DELETE FROM orders_read_once WHERE order_id % 2 = 0"], "orders_read_once")
    assert spark.read.parquet(f"{home}/tables/0").exceptAll(before).isEmpty()
    assert Path(home, "tables", "1").is_dir()


def test_a_million_dense_keys_are_numbered_in_several_tasks(spark):
    numbered = dense_positions(spark.range(200_000), "id", "place")
    assert numbered.filter("place <> id").isEmpty() and numbered.count() == 200_000
    assert (dense_positions.__defaults__[0] << 2) <= 1_000_000


def test_both_statements_read_a_stored_table(spark, sf):
    changes = queries.statement_changes(spark, sf)
    assert changes.inputFiles() and not any("orders.parquet" in f for f in changes.inputFiles())
