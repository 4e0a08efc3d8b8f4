"""The corpus pipeline: each stage on its own input, and all of them."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline

from changeflow.llm import common, packing, queries, secrets
from tools.check import TABLES, compare

WORDS = "the of and to in is that for with this from are was which have not they but".split()


def text(seed, n=60):
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i // 5) % len(WORDS)] + ("x" * ((seed + i) % 3)) for i in range(n))


def test_all_is_registered():
    names = contract.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert names["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing",
    ]


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_spark_and_sql_agree(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    verdict, _ = compare(spark, con, name, sf)
    assert verdict.startswith("ok"), verdict


def test_stages(spark, tmp_path):
    item = "what is the capital of the smallest country that nobody in this long question has ever named"
    found = [
        (1, text(1), "en"), (2, text(1), "en"), (3, text(3) + " " + item, "en"), (4, text(4) + " password=abcdefgh99 " + text(5), "en"),
        (5, "12345 !!!", "en"), (6, None, None), (7, text(7), None), (7, text(7), None), (None, text(9, 80), "en"), (8, text(11, 4000), "en"),
    ]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(found, schema).selectExpr("*", "'s' AS source", "CAST(length(text) AS bigint) AS n_chars", "1 AS row")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    sf_dir, left = str(tmp_path), {}
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES:
        out = common.saved(stage(spark, docs, sf_dir), name)
        left[name] = out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns
            docs = out
    ids = lambda name: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in left[name])
    assert ids("language_id") == [-1, 1, 2, 3, 4, 7, 7, 8]
    assert ids("near_duplicates") == [-1, 1, 3, 4, 7, 8]
    assert ids("decontamination") == ids("secret_scan") == [-1, 1, 4, 7, 8]
    four = next(r for r in left["secret_scan"] if r["doc_id"] == 4)
    assert "[assign]" in four["text"] and four["n_chars"] == len(four["text"]) and not secrets.find_secrets(four["text"])[1]
    pieces = left["best_fit_packing"]
    assert {r["doc_id"] for r in pieces} == {None, 1, 4, 7, 8}
    lengths = [r["length"] for r in pieces]
    assert len({r["sequence_id"] for r in pieces}) == packing.lower_bound(packing.np.array(lengths), 2048)
    whole = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect() if r["doc_id"] is not None)
    assert whole == sorted(tuple(r)[:5] for r in pieces if r["doc_id"] is not None)


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
