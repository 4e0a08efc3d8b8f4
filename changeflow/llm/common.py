"""Helpers shared by the operators: tables, written stages, worker set-up, batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from changeflow.session import run_dir

#: Rows turned into Python objects at a time; Arrow batches themselves are bounded in bytes by Spark.
SLICE = 256


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver did."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by name."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: For rows of megabytes that are compressed already: Parquet first looks at the size of a page and of a row
#: group after 100 rows, and holds all of these on the heap and once more in the codec's direct buffers.
LARGE_ROWS = {
    "compression": "uncompressed",
    "parquet.block.size": 16 << 20,
    "parquet.block.size.row.check.min": 1,
    "parquet.page.size.row.check.min": 1,
}


def saved(df: DataFrame, name: str, partition_by: str | None = None, options: dict | None = None) -> DataFrame:
    """``df`` written once to the shared folder, with Parquet's ``options``, and read back.

    This cuts the lineage: what comes after survives lost executors without recomputing it.
    """
    path = run_dir(df.sparkSession, name)
    writer = df.write.options(**(options or {}))
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Python tuples of the named columns, a slice at a time."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for at in range(0, batch.num_rows, SLICE):
        yield from zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)


def emitted(schema: pa.Schema, lists: list[list]) -> pa.RecordBatch:
    """A batch of the given columns."""
    return pa.RecordBatch.from_arrays(
        [pa.array(v, type=f.type) for v, f in zip(lists, schema, strict=True)], schema=schema
    )


def per_row(
    df: DataFrame,
    inputs: list[str],
    outputs: pa.Schema,
    ddl: str,
    make: Callable[[], Callable[..., tuple]],
) -> DataFrame:
    """One output row per input row, in one narrow stage.

    ``make`` runs once per task and returns the function that maps the inputs of a row to its
    outputs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            lists: list[list] = [[] for _ in outputs]
            for row in rows(batch, *inputs):
                for values, value in zip(lists, function(*row), strict=True):
                    values.append(value)
            if batch.num_rows:
                yield emitted(outputs, lists)

    return df.select(*inputs).mapInArrow(run, ddl)


class Memo(dict):
    """A bounded cache: entries that are not asked for during one generation are forgotten."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def make(self, key):
        raise NotImplementedError
