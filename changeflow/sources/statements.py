"""Insert, update, delete and truncate against a keyed table, as change envelopes.

The library never changes rows in place. A statement over the current rows becomes the envelopes
a source log would have carried, and the normal ingest applies them. ``first_seq`` is the log
position of the statement's first row; rows take positions from there on in key order. ``file`` names
the log file, such as one for each statement of a script.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.functions.ranks import dense_positions
from changeflow.schemas import CURRENT_COLUMNS
from changeflow.sources.feeds import envelopes


def _image(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in CURRENT_COLUMNS])


def _emit(rows: DataFrame, op: str, before: Column | None, after: Column | None, first_seq: int, ts_ms: int, file: str | None) -> DataFrame:
    numbered = dense_positions(rows, "order_id", "_pos")
    none = F.when(F.lit(False), before if after is None else after)
    return envelopes(
        numbered,
        op=F.lit(op),
        ts_ms=F.lit(ts_ms).cast("bigint"),
        before=none if before is None else before,
        after=none if after is None else after,
        seq=F.col("_pos") + first_seq,
        file=F.lit(file),
    )


def insert(rows: DataFrame, first_seq: int, ts_ms: int = 0, file: str | None = None) -> DataFrame:
    """``INSERT … VALUES``: one create per row."""
    return _emit(rows.select(*CURRENT_COLUMNS), "c", None, _image(""), first_seq, ts_ms, file)


def update(
    current: DataFrame, where: Column, changes: dict[str, Column], first_seq: int, ts_ms: int = 0, file: str | None = None
) -> DataFrame:
    """``UPDATE … SET … WHERE``: before and after images of every row that matches."""
    unknown = set(changes) - set(CURRENT_COLUMNS)
    if unknown:
        raise ValueError(f"no such column: {', '.join(sorted(unknown))}")
    new = [changes.get(c, F.col(c)).alias(f"_new_{c}") for c in CURRENT_COLUMNS]
    rows = current.select(*CURRENT_COLUMNS).filter(where).select("*", *new)
    return _emit(rows, "u", _image(""), _image("_new_"), first_seq, ts_ms, file)


def delete(current: DataFrame, where: Column, first_seq: int, ts_ms: int = 0, file: str | None = None) -> DataFrame:
    """``DELETE … WHERE``: one delete per row that matches."""
    rows = current.select(*CURRENT_COLUMNS).filter(where)
    return _emit(rows, "d", _image(""), None, first_seq, ts_ms, file)


def truncate(current: DataFrame, first_seq: int, ts_ms: int = 0, file: str | None = None) -> DataFrame:
    """``TRUNCATE``: a delete for every row, so that the table follows."""
    return delete(current, F.lit(True), first_seq, ts_ms, file)


