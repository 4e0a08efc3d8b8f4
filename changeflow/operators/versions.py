"""Versions of a change log that are numbers: plain Parquet with a version column.

Several writers may commit to one path. What orders their commits is the number each one claims, so
neither their clocks nor the numbers of their own batches matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.operators import state


def _files(spark: SparkSession, path: str):
    """The file system of ``path`` and a maker of paths on it."""
    make = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join(map(str, (path, *parts))))
    return make().getFileSystem(spark._jsc.hadoopConfiguration()), make


def _numbers(fs, folder) -> list[int]:
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n.removeprefix("version=")) for n in names if n.removeprefix("version=").isdigit())


def commit(changes: DataFrame, path: str) -> int:
    """Write ``changes`` as the next version of ``path`` and return its number, from 1.

    Rows go to a folder of their own first. A number is claimed by creating its file, which only one
    writer can do; whoever comes second takes the next one. Renaming the rows into place makes them visible.
    """
    spark = changes.sparkSession
    fs, at = _files(spark, path)
    draft = f"_draft-{spark._jvm.java.util.UUID.randomUUID()}"
    changes.write.parquet(f"{path}/{draft}")
    number = max([0, *_numbers(fs, at("_claims"))]) + 1
    while not fs.createNewFile(at("_claims", number)):
        number += 1
    if not fs.rename(at(draft), at(f"version={number}")):
        raise OSError(f"version {number} could not be put in place")
    return number


def changes_upto(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Change rows of all versions up to ``version`` (all of them by default), with the column ``version``.

    The version is a partition column, so later versions are not read.
    """
    rows = spark.read.parquet(path)
    return rows if version is None else rows.filter(F.col("version") <= version)


def as_of(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The keyed table as of a version. Claimed numbers below it that are not in place yet are an error:
    what a reader sees of a version never changes.
    """
    fs, at = _files(spark, path)
    missing = set(n for n in _numbers(fs, at("_claims")) if n <= version) - set(_numbers(fs, at()))
    if missing:
        raise ValueError(f"versions not in place yet: {sorted(missing)}")
    return state.current_state(changes_upto(spark, path, version).drop("version"))
