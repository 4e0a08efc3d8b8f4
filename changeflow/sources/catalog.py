"""The two tables in a session catalog: made if absent, and reset."""

from __future__ import annotations

from pyspark.sql import SparkSession

from changeflow.schemas import CHANGELOG, CURRENT

#: Table names and their columns.
TABLES = {"orders_current": CURRENT, "orders_changelog": CHANGELOG}


def create_tables(spark: SparkSession, namespace: str, location: str | None = None) -> list[str]:
    """Make the namespace (at ``location``) and both tables where they are absent; what is there stays."""
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {namespace}{at}")
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {namespace}.{name} ({columns}) USING parquet")
    return [f"{namespace}.{name}" for name in TABLES]


def reset_tables(spark: SparkSession, namespace: str) -> None:
    """Drop both tables with their files, past any trash, and make them again, empty."""
    for name in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {namespace}.{name} PURGE")
    create_tables(spark, namespace)


def drop_namespace(spark: SparkSession, namespace: str) -> None:
    """Drop the namespace with whatever it holds."""
    spark.sql(f"DROP DATABASE IF EXISTS {namespace} CASCADE")
