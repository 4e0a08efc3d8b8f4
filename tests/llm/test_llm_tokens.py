"""Encoding, token files and token counts, against the library itself."""

from __future__ import annotations

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from changeflow.llm import bpe, packing, pieces, tokencount, tokenfile

ODD = [
    "", " ", "a", "a  b", " a b ", "it's I'LL ", "x \n y", "a\n\n b\t c", "\n a", "日本 語 a", "a 日 本", "\x85 a\x1c b",
    "a　 b", "a b  c", "<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|>b c", "<|endoftext|><|endoftext|>", "<|endoftext| >", "🙂 🙂🙂 é", "a'sb 'll", "½ ²a", "q\U0010ffffz a b", "a\x0b b", "a b\n",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encode():
    return bpe.Encoder()


def docs(spark, found, extra=""):
    return spark.createDataFrame(found, "doc_id long, text string" + extra)


def test_batches_equal_whole_calls(encode, library):
    mix = [*ODD, None, *ODD[::-1], "word " * 50]
    ((_, ids, bounds),) = encode(pa.array(mix, pa.string()))
    for i, text in enumerate(mix):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library(text), text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab '.,1\n\t é日  s")), max_size=30))
def test_any_text_equals_a_whole_call(encode, library, text):
    assert encode.ids(text).tolist() == library(text)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_segments_round_trip(planes):
    ids = np.random.default_rng(1).integers(0, 50257, 200_000).astype("<u4")
    counts = np.array([150_000, 0, 50_000])
    got = tokenfile.Segment(tokenfile.segment(ids, [5, None, 7], counts, 3, 1, 9, planes, 3))
    assert (got.task, got.number, got.before, got.doc_ids, got.counts.tolist()) == (3, 1, 9, [5, None, 7], counts.tolist())
    for a, b in ((0, 200_000), (65_535, 65_537), (10, 10), (199_999, 200_000)):
        assert (got.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        tokenfile.Segment(b"x" * 200)


def test_token_files(spark, tmp_path, library):
    found = [(3, "c c"), (1, "a b"), (None, "n"), (2, None), (1, "again"), (1, "a b"), (9, "")]
    path = str(tmp_path / "files")
    tokenfile.write_tokens(docs(spark, found), path, segment_ids=4, planes="bit")
    rows = sorted(tokenfile.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 1, 2, 3, 9]
    start = 0
    for r in rows:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    want = sorted((i or -1, *library(t), 0) for i, t in found)
    assert sorted((r["doc_id"] or -1, *r["ids"]) for r in rows) == want


def test_token_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    tokenfile.write_tokens(docs(spark, []), path)
    assert tokenfile.read_tokens(spark, path).count() == 0


def test_token_file_query(spark, sf, library):
    rows = sorted(tokenfile.op5_token_files(spark, sf).collect(), key=lambda r: r["doc_id"])
    given_ = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    start = 0
    for r, (doc_id, text) in zip(rows, given_, strict=True):
        ids = [*library(text), 0]
        assert tuple(r) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


# -- packing ------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_is_sound_and_bounded(lengths):
    lengths = np.array(lengths, np.int64)
    where = packing.best_fit(lengths, 20)
    used = len(set(where.tolist()))
    assert used >= packing.lower_bound(lengths, 20) >= -(-int(lengths.sum()) // 20)
    if used:
        assert np.bincount(where, weights=lengths).max() <= 20 and set(where.tolist()) == set(range(used))


def test_dual_feasible_bounds_beat_the_sum():
    assert packing.lower_bound(np.array([11] * 7), 20) == 7
    assert packing.lower_bound(np.array([7] * 9), 20) == 5  # two sevens to a sequence


def test_a_worse_repack_keeps_the_old_sequences():
    lengths, before = np.array([6, 4, 5, 5]), np.array([70, 70, 71, 71])
    where, given_ = packing.repacked(lengths, before, 10, True)
    assert len(set(where.tolist())) == 2 and not given_.any()


def valid(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_exchange_rounds(spark):
    lengths = np.random.default_rng(2).integers(1, 101, 900)
    found = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "key long, length long")
    rows = packing.pack(found, 100, bucket=60).collect()
    assert sorted((r["key"], r["length"]) for r in rows) == list(enumerate(lengths))
    apart = packing.pack(found, 100, bucket=60, rounds=1).collect()
    assert packing.lower_bound(lengths, 100) <= valid(rows, 100) < valid(apart, 100)
    assert valid(rows, 100) <= packing.lower_bound(lengths, 100) * 1.04


def test_packing_of_odd_rows(spark, library):
    found = [(1, "one two three four five six seven eight"), (None, "x"), (2, None), (1, ""), (1, "")]
    rows = packing.packed_documents(docs(spark, found), capacity=3, with_ids=True).collect()
    assert valid(rows, 3) == -(-sum(r["length"] for r in rows) // 3)
    long_ = sorted((r for r in rows if r["doc_id"] == 1 and r["length"] > 1 or r["piece"] > 0), key=lambda r: r["piece"])
    ids = [i for r in long_ for i in r["ids"]]
    assert ids[-3:] == [*library(found[0][1]), 0][-3:] and all(r["length"] == 3 for r in long_[1:])
    assert sum(r["length"] == 1 and r["ids"] == [0] for r in rows) == 3
    assert packing.packed_documents(docs(spark, [])).count() == 0


def test_packing_query(spark, sf, library):
    rows = packing.op8_packing(spark, sf).collect()
    lengths = np.array([r["length"] for r in rows])
    assert 0 <= valid(rows, 2048) - packing.lower_bound(lengths, 2048) <= 1
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(texts)
    for doc_id, own in by.items():
        ids, at = [*library(texts[doc_id]), 0], 0
        for k, r in enumerate(sorted(own, key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(part))
            assert r["length"] == 2048 or k == 0
            at += r["length"]
        assert at == len(ids)


# -- counts under the unigram model ------------------------------------------------------------


@pytest.fixture(scope="module")
def unigram():
    found, scores = pieces.vocabulary()
    model = Tokenizer(models.Unigram(list(zip(found, scores, strict=True)), unk_id=0, byte_fallback=True))
    model.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(model.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abtheion ▁\n日🙂é<0x>")), max_size=30))
def test_counts_equal_the_library(unigram, text):
    counts = np.concatenate([c for c, _ in tokencount.counter()(pa.array([text]))])
    assert counts.tolist() == [unigram(text)]


def test_token_counts(spark, sf, unigram):
    given_ = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.op3_token_counts(spark, sf).collect()}
    assert got == {i: unigram(t) for i, t in given_}
    odd = docs(spark, [(None, "a"), (1, None), (1, "▁"), (1, "")])
    rows = [tuple(r) for r in tokencount.count_tokens(odd.withColumn("n_tokens", odd.doc_id)).collect()]
    assert sorted(r[1] for r in rows) == sorted([unigram("a"), 0, unigram("▁"), 0])
    assert tokencount.count_tokens(docs(spark, [])).count() == 0
