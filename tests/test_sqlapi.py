from __future__ import annotations

import pytest
from conftest import rows

from changeflow.plans import queries as Q
from changeflow.plans import sqlapi
from changeflow.streaming.table import ChangeTable


def test_tables_answer_plain_sql(spark, sf, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t")).create()
    table.append_envelopes(Q.orders_feed(spark, sf), "w", 0)
    sqlapi.register(spark, table, Q.orders_current(spark, sf))
    count = "SELECT count(*) FROM "
    assert sqlapi.sql(spark, count + "orders_current").first()[0] == 1343
    assert sqlapi.sql(spark, count + "orders_changelog").first()[0] == 4615
    both = "SELECT * FROM orders_source EXCEPT SELECT * FROM orders_current"
    assert sqlapi.sql(spark, both).count() == 0


@pytest.mark.parametrize("query", [None, "", "  "])
def test_a_query_is_required(spark, query):
    with pytest.raises(ValueError, match="query is required"):
        sqlapi.sql(spark, query)


def test_tab_separated_rows_come_back(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, CAST(NULL AS STRING) AS c, TIMESTAMP_NTZ'2026-01-01 00:00:01.5' AS d")
    assert sqlapi.tsv(df).first()["line"] == "1\tx\tNULL\t2026-01-01 00:00:01.500"
    path = str(tmp_path / "tsv")
    sqlapi.write_tsv(df, path)
    assert sqlapi.read_tsv(spark, path, "a int, b string, c string, d string").first()[:3] == (1, "x", None)
    with pytest.raises(Exception, match="MALFORMED"):
        sqlapi.read_tsv(spark, path, "a int, b string").collect()


def test_clean_lines(spark):
    data = ["a", "", "  ", "WARNING: x", "SLF4J: y", "log4j:WARN z", " WARNING: kept"]
    df = spark.createDataFrame([(x,) for x in data], "value string")
    assert rows(sqlapi.clean_lines(df)) == [(" WARNING: kept",), ("a",)]


def test_table_names():
    parts = lambda name: sqlapi.table_parts(name, "cat", "db")
    assert parts("t") == ("cat", "db", "t")
    assert parts("x.t") == ("cat", "x", "t")
    assert parts("c.x.t") == ("c", "x", "t")
    for bad in ("", "a.b.c.d", "a..b"):
        with pytest.raises(ValueError):
            parts(bad)
