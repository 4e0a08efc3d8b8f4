"""Packing documents into token sequences of a fixed length, with certified bin counts.

Documents are tokenised where they lie and only lengths travel. Buckets of pieces are packed by
best-fit decreasing. A lower bound from dual feasible functions says how many sequences a bucket
needs at least; a bucket above its bound gives its emptiest sequences away, and every bucket its
last open one. What was given away meets in fewer buckets and is packed again, until one bucket
is left; a repack that needs more sequences than it got keeps the old ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.bpe import encoder
from changeflow.llm.common import ready, saved, table

LENGTH, END = 2048, 0
#: Pieces packed in one task, and rounds of exchange at most (the last one closes everything).
BUCKET, ROUNDS = 20_000, 8
#: Of a bucket above its bound: waste it gives away, in sequences per sequence above the bound.
GIVEN = 4

PIECES = pa.schema(
    [
        ("key", pa.int64()),
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.list_(pa.int32())),
    ]
)
PIECES_DDL = "key long, doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    with_ids: bool = False,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """Pieces of every document's ids and end id; only documents above ``length`` are cut.

    The first piece takes what is left over. ``key`` tells rows apart, also equal ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, key = encoder(tokenizer_path), TaskContext.get().partitionId() << 36
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for at, ids, bounds in encode(batch.column(1)):
                ids = np.insert(ids, bounds[1:], END)
                bounds = bounds + np.arange(len(bounds))
                data = memoryview(ids).cast("B")
                out: list[list] = [[] for _ in PIECES]
                for row in range(len(bounds) - 1):
                    first, n = int(bounds[row]), int(bounds[row + 1] - bounds[row])
                    cuts = [0, *range(n - (n - 1) // length * length, n + 1, length)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        crc = zlib.crc32(data[4 * (first + a) : 4 * (first + b)])
                        own = ids[first + a : first + b].astype("<i4") if with_ids else None
                        for values, v in zip(out, (key, doc_ids[at + row], k, a, b - a, crc, own), strict=True):
                            values.append(v)
                        key += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=f.type) for v, f in zip(out, PIECES, strict=True)], schema=PIECES
                )

    ready(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = picked.mapInArrow(run, PIECES_DDL)
    return found if with_ids else found.drop("ids")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that these lengths need at least, by two families of dual feasible functions."""
    counts = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    if not counts.any():
        return 0
    sizes = np.arange(capacity + 1)
    tokens, upto = np.concatenate([[0], np.cumsum(counts * sizes)]), np.concatenate([[0], np.cumsum(counts)])
    # Above capacity - a: a sequence of its own. From a to capacity - a: its share. Below a: nothing.
    a = np.arange(capacity // 2 + 1)
    large = upto[-1] - upto[capacity - a + 1]
    middle = tokens[capacity - a + 1] - tokens[a]
    best = int((large + -(-middle // capacity)).max())
    # Shares rounded down to multiples of 1/k, except where (k + 1) shares come out whole.
    for k in range(1, 33):
        share = (k + 1) * sizes
        units = np.where(share % capacity == 0, share * k // (k + 1), share // capacity * capacity)
        best = max(best, -(-int((counts * units).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece, by best-fit decreasing."""
    order = np.argsort(-lengths, kind="stable")
    where = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, used = 0, 0  # bit r of some: a sequence with room r
    for at in order.tolist():
        size = int(lengths[at])
        fit = some >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            bin_ = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, bin_, used = capacity, used, used + 1
        where[at] = bin_
        room[r - size].append(bin_)
        some |= 1 << (r - size)
    return where


def repacked(lengths: np.ndarray, before: np.ndarray, capacity: int, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sequence of each piece, and whether its sequence is given away for another round."""
    where = best_fit(lengths, capacity)
    old, as_before = np.unique(before, return_inverse=True)
    if (before >= 0).all() and len(old) and len(old) < where.max() + 1:
        where = as_before
    filled = np.bincount(where, weights=lengths).astype(np.int64)
    gap = len(filled) - lower_bound(lengths, capacity)
    given = np.zeros(len(filled), bool)
    if not last:
        emptiest = np.argsort(filled, kind="stable")
        waste = np.cumsum(capacity - filled[emptiest])
        enough = int(np.searchsorted(waste, gap * GIVEN * capacity, "left")) + 1
        given[emptiest[:enough]] = True
    return where, given[where]


def _packer(columns: list[str], capacity: int, round_: int, last: bool):
    def one(key: tuple[pa.Scalar, ...], some: pa.Table) -> pa.Table:
        some = some.sort_by("key")
        lengths = some["length"].to_numpy().astype(np.int64)
        where, given = repacked(lengths, some["sequence_id"].to_numpy(), capacity, last)
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(lengths[order])
        fresh = np.concatenate([[True], np.diff(where[order]) > 0])
        begins = ends - lengths[order]
        offsets = np.empty(len(where), np.int64)
        offsets[order] = begins - np.maximum.accumulate(np.where(fresh, begins, 0))
        names = (round_ << 56) + (int(key[0].as_py()) << 26) + where
        out = some.select(columns)
        for name, values in (("sequence_id", names), ("offset", offsets), ("_open", given)):
            out = out.append_column(name, pa.array(values))
        return out

    return one


def pack(found: DataFrame, capacity: int = LENGTH, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """``found(key, length, ...)`` with ``sequence_id`` and ``offset``; lengths are 1 to capacity.

    Offsets run gapless from 0 within a sequence. No rows give no rows.
    """
    spark, columns = found.sparkSession, found.columns
    schema = found.withColumns({c: F.lit(0).cast("long") for c in ("sequence_id", "offset")}).withColumn(
        "_open", F.lit(False)
    ).schema
    waiting, closed, n = found.withColumn("sequence_id", F.lit(-1).cast("long")), [], found.count()
    for round_ in range(rounds):
        buckets = max(1, -(-n // bucket))
        last = buckets == 1 or round_ == rounds - 1
        spread = F.when(F.col("sequence_id") < 0, F.xxhash64("key")).otherwise(F.xxhash64("sequence_id"))

        dealt = waiting.withColumn("_bucket", F.pmod(spread, F.lit(buckets)))
        done = saved(dealt.groupBy("_bucket").applyInArrow(_packer(columns, capacity, round_, last), schema), "packed")
        if last:
            closed.append(done)
            break
        closed.append(done.where("NOT _open"))
        waiting = done.where("_open").drop("offset", "_open")
        n = waiting.count()
        if not n:
            break
    out = closed[0]
    for more in closed[1:]:
        out = out.union(more)
    return out.drop("_open")


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place, and their ids if asked for.

    A null or empty text is its end id alone. Null ids and repeated rows are documents of their
    own. No rows give no rows.
    """
    found = saved(pieces(docs, id_col, text_col, capacity, with_ids), "pieces")
    placed = pack(found.drop("ids"), capacity)
    if with_ids:
        placed = placed.join(found.select("key", "ids"), "key")
    return placed.drop("key")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
