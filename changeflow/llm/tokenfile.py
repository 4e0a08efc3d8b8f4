"""Token ids in files of bit or byte planes, with a chunk index.

A segment is one self-contained file. Integers are little-endian.

    magic        4 bytes "TPL1"
    chunks       per chunk and plane: a zstandard frame
    documents    zstandard frame: n ids (int64), n flags "has an id" (uint8), n token counts (uint64)
    index        per chunk: first id of the segment (uint64), ids (uint32), then per plane
                 offset (uint64) and size (uint32)
    footer       task, segment, planes, width (uint32 each), ids before it in its task, ids,
                 documents, chunks (uint64 each), offset and size of documents, offset of the
                 index (uint64 each), magic

A chunk's ids are transposed: plane k holds byte k (or bit k) of each id, so the high planes of a
small vocabulary are constant and cost next to nothing. Spark's own writer puts the segments in
place, so a file appears only when its task commits, on any store Spark can write to.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.bpe import encoder
from changeflow.llm.common import ready, saved, table
from changeflow.session import run_dir

MAGIC, END = b"TPL1", 0
#: Ids in a chunk, and ids after which a segment is closed (a document is never split over two).
CHUNK, SEGMENT = 1 << 16, 1 << 22
FOOTER = struct.Struct("<4I7Q4s")


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The byte or bit planes of unsigned 32-bit ids."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [p.tobytes() for p in np.ascontiguousarray(raw.T)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in bits.T]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    """The ids back from four byte planes or 32 bit planes."""
    if len(parts) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8, n) for p in parts], axis=1)
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts]
        raw = np.packbits(np.stack(bits, axis=1), axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def segment(
    ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray, task: int, number: int, before: int, planes: str, level: int
) -> bytes:
    """One file's bytes."""
    pack, out, index = zstandard.ZstdCompressor(level=level).compress, [MAGIC], []
    at = len(MAGIC)
    for first in range(0, len(ids), CHUNK):
        some = ids[first : first + CHUNK]
        entry = struct.pack("<QI", first, len(some))
        for plane in to_planes(some, planes):
            frame = pack(plane)
            entry += struct.pack("<QI", at, len(frame))
            out.append(frame)
            at += len(frame)
        index.append(entry)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    numbers = np.array([0 if i is None else i for i in doc_ids], "<i8")
    docs = pack(numbers.tobytes() + known.tobytes() + counts.astype("<u8").tobytes())
    width = 4 if planes == "byte" else 32
    footer = FOOTER.pack(
        task, number, width, CHUNK, before, len(ids), len(doc_ids), len(index), at, len(docs), at + len(docs), MAGIC
    )
    return b"".join([*out, docs, *index, footer])


class Segment:
    """Reads one file's bytes; ``ids(a, b)`` opens only the chunks it needs."""

    def __init__(self, data: bytes):
        (
            self.task, self.number, self.width, self.chunk, self.before, self.n_ids, n_docs, n_chunks, docs_at, docs_size, index_at, magic,
        ) = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC or data[:4] != MAGIC:
            raise ValueError("not a segment of token planes")
        self.data, self.unpack = data, zstandard.ZstdDecompressor().decompress
        raw = self.unpack(data[docs_at : docs_at + docs_size])
        known = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
        self.doc_ids = [i if k else None for i, k in zip(np.frombuffer(raw, "<i8", n_docs).tolist(), known, strict=True)]
        self.counts = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        entry = struct.Struct("<QI" + "QI" * self.width)
        self.index = [entry.unpack_from(data, index_at + k * entry.size) for k in range(n_chunks)]

    def _chunk(self, k: int) -> np.ndarray:
        _, n, *places = self.index[k]
        parts = [self.unpack(self.data[a : a + size]) for a, size in zip(places[::2], places[1::2], strict=True)]
        return from_planes(parts, n)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, "<u4")
        first = start // self.chunk
        some = np.concatenate([self._chunk(k) for k in range(first, (end - 1) // self.chunk + 1)])
        return some[start - first * self.chunk : end - first * self.chunk]


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    planes: str = "byte",
    level: int = 3,
    segment_ids: int = SEGMENT,
    tokenizer_path: str | None = None,
) -> None:
    """Ids and end id of every document, in ascending id order, as files of token planes.

    Null ids come first, equal ids in the order of a hash of their text. Null and empty texts are
    their end id. Ranges are cut by id and that hash, so no id, however often it is repeated,
    makes a large file. No rows make no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_path), TaskContext.get().partitionId()
        parts, doc_ids, counts, held, before, number = [], [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            data = segment(ids, doc_ids, np.array(counts), task, number, before, planes, level)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, ids, bounds in encode(batch.column(1)):
                ids = np.insert(ids, bounds[1:], END)
                bounds = bounds + np.arange(len(bounds))
                parts.append(ids)
                doc_ids += names[at : at + len(bounds) - 1]
                counts += np.diff(bounds).tolist()
                held += len(ids)
                if held >= segment_ids:
                    yield closed()
                    parts, doc_ids, counts, held, before, number = [], [], [], 0, before + held, number + 1
        if doc_ids:
            yield closed()

    ready(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.withColumn("mark", F.xxhash64("text"))
    ordered = picked.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").select("id", "text")
    files = ordered.mapInArrow(run, "value binary")
    # One record to a file. The writer ends each with one separator byte, which readers cut off.
    (
        files.select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\n")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` from the files; start counts all ids before.

    Each file is checked and opened where it is read; only one total per writing task meets on
    the driver. A folder without files gives no rows.
    """
    schema = pa.schema(
        [
            ("task", pa.int64()),
            ("doc_id", pa.int64()),
            ("inside", pa.int64()),
            ("n_tokens", pa.int64()),
            ("ids_crc32", pa.int64()),
            ("ids", pa.list_(pa.int32())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                got = Segment(content.as_py()[:-1])
                ends = np.cumsum(got.counts)
                ids = got.ids(0, got.n_ids)
                if len(ends) and ends[-1] != len(ids):
                    raise ValueError("a segment's documents and ids disagree")
                data = memoryview(ids).cast("B")
                begins = ends - got.counts
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(ends)
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    own = pa.ListArray.from_arrays(offsets, pa.array(ids.astype("<i4")))
                else:
                    own = pa.nulls(n, pa.list_(pa.int32()))
                columns = [pa.array(np.full(n, got.task)), pa.array(got.doc_ids, pa.int64()), pa.array(got.before + begins)]
                columns += [pa.array(got.counts), pa.array(crc, pa.int64()), own]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    files = ready(spark).read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.where("length > 0").select("content")
    ddl = "task long, doc_id long, inside long, n_tokens long, ids_crc32 long, ids array<int>"
    found = files.mapInArrow(run, ddl)
    found = saved(found if with_ids else found.drop("ids"), "tokens")
    totals = sorted(tuple(r) for r in found.groupBy("task").agg(F.sum("n_tokens")).collect())
    before, starts = 0, []
    for task, n in totals:
        starts.append((task, before))
        before += n
    base = spark.createDataFrame(starts, "task long, base long")
    out = found.join(F.broadcast(base), "task").withColumn("start", F.col("base") + F.col("inside"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = run_dir(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
