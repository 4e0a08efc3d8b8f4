"""Sources: tables, source database, reporter text, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changeflow.schemas import CURRENT, CURRENT_COLUMNS


def stored_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table by path; the store is whatever the path's scheme and the Hadoop settings say."""
    return spark.read.format(fmt).load(path)


def source_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The eight business columns of a source table in their declared types."""
    return spark.read.format(fmt).schema(CURRENT).load(path).select(*CURRENT_COLUMNS)


def jdbc_rows(
    spark: SparkSession,
    url: str,
    dbtable: str,
    *,
    lower: int,
    upper: int,
    partitions: int,
    key: str = "order_id",
    fetch_size: int = 10_000,
    **options: str,
) -> DataFrame:
    """The same from a database, read in parallel by key ranges (driver jar on the class path)."""
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", dbtable)
        .option("partitionColumn", key)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .option("fetchsize", fetch_size)
    )
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select(*CURRENT_COLUMNS)


def reporter_text(spark: SparkSession, path: str) -> DataFrame:
    """Saved metric scrapes, one row per line (column ``value``)."""
    return spark.read.text(path)
