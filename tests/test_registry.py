from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
from changeflow.plans.oracles import ORACLES
from changeflow.plans.queries import QUERIES
from tools.check import TABLES, compare


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    return con


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_spark_and_sql_agree(spark, con, sf, name):
    verdict, _ = compare(spark, con, name, sf)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["status", "orders", "amount_cents"]
    assert sum(r["orders"] for r in df.collect()) == 1343
