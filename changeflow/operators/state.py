"""Keyed state from change rows: latest per key, merge-on-read, versions, snapshot plus tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeflow.operators.decode import DELETE, UPDATE_BEFORE, position_order
from changeflow.schemas import CURRENT_COLUMNS, POSITION_COLUMNS

#: Keys that may be broadcast (8 bytes each, about 80 MB in memory); more take the shuffle path.
BROADCAST_KEYS = 5_000_000


def latest_by_key(changes: DataFrame, key: str = "order_id", keep_deletes: bool = False) -> DataFrame:
    """The newest change of every key by log position, the image after over the image before.

    One shuffle. Each task reduces its rows to one per key first, so a key with a third of all
    rows sends one row per task, and its final group holds a single row of state.
    Update-before rows never win a key and are dropped before the shuffle.
    """
    others = [c for c in changes.columns if c != key]
    newest = F.max_by(F.struct(*others), position_order(changes))
    rows = (
        changes.filter(F.col("cdc_row_kind") != UPDATE_BEFORE)
        .groupBy(key)
        .agg(newest.alias("_row"))
        .select(key, "_row.*")
        .select(*changes.columns)
    )
    return rows if keep_deletes else rows.filter(F.col("cdc_row_kind") != DELETE)


def current_state(changes: DataFrame) -> DataFrame:
    """The keyed table: newest change per key, deleted keys gone."""
    return latest_by_key(changes).select(*CURRENT_COLUMNS)


def apply_equality_deletes(
    data: DataFrame, deletes: DataFrame, key: str = "order_id", salt: int = 1
) -> DataFrame:
    """Data rows not deleted later: a row is dead if a delete of its key has a larger position.

    Only the last delete of a key matters, so deletes shrink to one row per key before they meet
    the data: the join never pairs a key's rows with each other. They are dealt out once more before
    the join, because adaptive execution splits a hot key of the data only where both sides come
    straight from a shuffle; ``salt`` splits it where that is off.
    """
    at = position_order(data, image=False)
    last = deletes.groupBy(key).agg(F.max(position_order(deletes, image=False)).alias("_dead_before"))
    if salt > 1:
        data = data.withColumn("_salt", F.pmod(F.xxhash64(at), F.lit(salt)).cast("int"))
        last = last.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        keep = (data[key] == last[key]) & (data["_salt"] == last["_salt"])
        keep &= at < last["_dead_before"]
        return data.join(last, keep, "left_anti").drop("_salt")
    last = last.hint("rebalance")
    keep = (data[key] == last[key]) & (at < last["_dead_before"])
    return data.join(last, keep, "left_anti")


def upsert_files(changes: DataFrame, key: str = "order_id") -> tuple[DataFrame, DataFrame]:
    """Split a changelog as an upsert writer does: data rows, and deletes by key.

    Every insert or update also deletes older rows of its key; a delete only deletes.
    """
    kept = changes.filter(F.col("cdc_row_kind") != UPDATE_BEFORE)
    data = kept.filter(F.col("cdc_row_kind") != DELETE)
    deletes = kept.select(key, *[c for c in POSITION_COLUMNS if c in kept.columns])
    return data, deletes


def as_of(changes: DataFrame, upto: int) -> DataFrame:
    """Current rows as a reader of version ``upto`` saw them; later batches are never read."""
    return current_state(changes.filter(F.col("batch_id") <= upto))


def snapshot_plus_tail(
    snapshot: DataFrame, tail: DataFrame, tail_rows: int | None = None, key: str = "order_id"
) -> DataFrame:
    """Newest change per key of a compacted snapshot and the changes committed after it.

    ``snapshot`` holds one row per key, deletes included, so that a late, older change cannot
    bring a deleted key back. When the tail is known to be small (``tail_rows``, from the commit
    log) its keys are broadcast: snapshot rows it does not touch pass through without a shuffle.
    Otherwise both sides meet in one aggregation.
    """
    tail = tail.select(*snapshot.columns)
    if tail_rows is None or tail_rows > BROADCAST_KEYS:
        return latest_by_key(snapshot.unionByName(tail), key, keep_deletes=True)
    touched = F.broadcast(tail.select(key).distinct())
    same = snapshot.join(touched, key, "left_anti")
    met = snapshot.join(touched, key, "left_semi").unionByName(tail)
    return same.unionByName(latest_by_key(met, key, keep_deletes=True))


def live_rows(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("cdc_row_kind") != DELETE).select(*CURRENT_COLUMNS)


def position_conflicts(changes: DataFrame, key: str = "order_id") -> DataFrame:
    """Positions a key uses more than once: any row here means its history has no total order."""
    return (
        changes.groupBy(key, *[c for c in (*POSITION_COLUMNS, "_img") if c in changes.columns])
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )
