"""Near-duplicate documents by 64-bit SimHash fingerprints and pigeonhole blocks.

Two fingerprints that differ in at most three bits agree on at least one of four blocks of bits.
Blocks are the join keys; what meets there is compared bit by bit. A block value that too many
fingerprints share is cut again by the same argument, four ways through its remaining bits, until
what meets is small; so no pair is lost and no group has to fit anywhere.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import emitted, ready, rows, saved, table
from changeflow.llm.graph import components

WORDS, SEED, MAX_BITS = 3, 42, 3
#: Fingerprints compared in one place; a fuller block is cut again. A bound on memory, not on links.
MEETING = 1024
#: Shingles hashed at a time.
AT_ONCE = 1 << 16
#: Groups up to this size are compared by shifting a whole batch against itself.
NARROW = 24


def fingerprint(text: bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    """Fingerprint of a text's bytes as a signed 64-bit number; zero without words."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        some = found[at : at + AT_ONCE + words - 1]
        shingles = map(b" ".join, zip(*(some[k:] for k in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(id, fp)`` per row. Null texts count as empty."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(i, fingerprint(t, words)) for i, t in rows(batch, "id", "text")]
            if pairs:
                yield emitted(schema, [list(c) for c in zip(*pairs, strict=True)])

    ready(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return picked.mapInArrow(run, "id long, fp long")


@functools.lru_cache(maxsize=1 << 16)
def below(fixed: int) -> tuple[int, ...]:
    """The bits that are fixed after one more cut of the free ones, four ways; signed numbers."""
    whole = fixed & (1 << 64) - 1
    free = [b for b in range(64) if not whole >> b & 1]
    cuts = [round(len(free) * k / (MAX_BITS + 1)) for k in range(MAX_BITS + 2)]
    more = (whole | sum(1 << b for b in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False))
    return tuple(m - (1 << 64) if m >> 63 else m for m in more)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each ``(fp, fixed)`` under the four blocks below: ``(fp, fixed, part)``."""
    for batch in batches:
        fps, fixed = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ways, which = np.unique(fixed, return_inverse=True)
        masks = np.array([below(w) for w in ways.tolist()], np.int64).reshape(-1, MAX_BITS + 1)[which]
        out = [np.repeat(fps, MAX_BITS + 1), masks.ravel(), (masks & fps[:, None]).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["fp", "fixed", "part"])


def near_links(found: DataFrame, meeting: int = MEETING) -> DataFrame:
    """Links ``(a, b)`` that join all distinct fingerprints of ``found(fp)`` within three bits.

    Not all pairs: what a block's fingerprints reach by steps of three bits hangs together by one
    of them. A block that still is too
    full when few bits are left free holds at most as many fingerprints as these bits can tell
    apart.
    """
    waiting, met = found.select("fp", F.lit(0).cast("long").alias("fixed")), None
    while True:
        keyed = waiting.mapInArrow(_cut, "fp long, fixed long, part long")
        full = keyed.groupBy("fixed", "part").count()
        few = F.lit(64) - F.bit_count("fixed") <= max(1, meeting.bit_length() - 1)
        full = saved(full.where((F.col("count") > meeting) & ~few).select("fixed", "part"), "blocks")
        last = full.isEmpty()
        calm = keyed if last else keyed.join(full, ["fixed", "part"], "left_anti")
        calm = calm.select("fp", F.xxhash64("fixed", "part").alias("key"))
        met = calm if met is None else met.union(calm)
        if last:
            break
        waiting = saved(keyed.join(full, ["fixed", "part"], "left_semi").select("fp", "fixed"), "blocks")
    return met.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet, "a long, b long").distinct()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among the fingerprints that stand together under a key; input is sorted by key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = linked(keys, fps)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, batch.column(batch.schema.get_field_index("key")).to_numpy()])
        fps = np.concatenate([fps, batch.column(batch.schema.get_field_index("fp")).to_numpy()])
        done = int(np.searchsorted(keys, keys[-1], "left"))
        if done:
            yield out(keys[:done], fps[:done])
        keys, fps = keys[done:], fps[done:]
    if len(keys):
        yield out(keys, fps)


def linked(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within three bits for small groups; in larger ones each fingerprint with the first of
    those it reaches by steps of three bits."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    a, b = [], []
    narrow = np.repeat(sizes <= NARROW, sizes)
    some, group = fps[narrow], np.repeat(np.arange(len(sizes)), sizes)[narrow]
    for step in range(1, min(NARROW, len(some))):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        near = same & (np.bitwise_count((some[step:] ^ some[:-step]).view(np.uint64)) <= MAX_BITS)
        a.append(some[step:][near])
        b.append(some[:-step][near])
    for start, size in zip(starts[sizes > NARROW], sizes[sizes > NARROW], strict=True):
        rest = np.unique(fps[start : start + size])
        while len(rest):
            root, rest = rest[0], rest[1:]
            edge = np.array([root])
            while len(edge) and len(rest):
                near = np.zeros(len(rest), bool)
                for at in range(0, len(edge), 256):
                    apart = np.bitwise_count((edge[at : at + 256, None] ^ rest[None, :]).view(np.uint64))
                    near |= (apart <= MAX_BITS).any(axis=0)
                edge, rest = rest[near], rest[~near]
                a.append(edge)
                b.append(np.full(len(edge), root))
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` per row: the group of near-duplicates a document belongs to.

    Fingerprints link at three or fewer differing bits; groups are what links reach. The
    component is named by its smallest id. Null texts are empty, texts without words have
    fingerprint zero and link like others, repeated rows stay, rows without an id are grouped but
    never name a group (null if no row of the group has an id). No rows give no rows.
    """
    prints = saved(fingerprints(docs, id_col, text_col), "fingerprints")
    least = saved(prints.groupBy("fp").agg(F.min("id").alias("least")), "least")
    group = components(near_links(least.select("fp")))
    named = least.join(group, least.fp == group.node, "left").drop("node")
    named = named.withColumn("root", F.coalesce("root", "fp"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.select("fp", "root").join(names, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("id", "fp", "component_id")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with all columns: that of the smallest id.

    Rows that share an id are told apart by their contents; of equal rows one stays. A group
    whose rows all lack an id keeps the row whose contents hash lowest.
    """
    whole = docs.select(F.struct("*").alias("row"))
    whole = whole.select(
        "row",
        F.col(f"row.{id_col}").cast("long").alias("id"),
        F.xxhash64("row").alias("mark"),
        F.col(f"row.{text_col}").alias("text"),
    )
    schema = pa.schema([("id", pa.int64()), ("mark", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, m, fingerprint(t)) for i, m, t in rows(batch, "id", "mark", "text")]
            if found:
                yield emitted(schema, [list(c) for c in zip(*found, strict=True)])

    ready(docs.sparkSession)
    picked = whole.select("id", "mark", F.col("text").cast("binary").alias("text"))
    prints = saved(picked.mapInArrow(run, "id long, mark long, fp long"), "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first")
    least = saved(prints.groupBy("fp").agg(first), "least")
    group = components(near_links(least.select("fp")))
    named = least.join(group, least.fp == group.node, "left").withColumn("root", F.coalesce("root", "fp"))
    chosen = named.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.mark")
    picks = chosen.select(F.col("id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    kept = whole.select("row", "id", "mark").join(
        picks, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left_semi"
    )
    return kept.groupBy("id", "mark").agg(F.first("row").alias("row")).select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
