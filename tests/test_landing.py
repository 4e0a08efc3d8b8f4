from __future__ import annotations

from pathlib import Path

import pytest

from changeflow.plans import queries
from changeflow.streaming import ingest


def test_files_are_bounded_and_rows_stay_where_they_are(spark, tmp_path, sf, monkeypatch):
    feed = queries.orders_feed(spark, sf)
    n = feed.count()
    assert ingest.land(feed, str(tmp_path / "few"), batches=3) == 1
    assert len(list((tmp_path / "few").glob("*.json.gz"))) == 3
    monkeypatch.setattr(ingest, "LANDING_ROWS", 100)
    each = ingest.land(feed, str(tmp_path / "many"), batches=3)
    files = list((tmp_path / "many").glob("*.json.gz"))
    assert len(files) == -(-n // 100) and each == -(-len(files) // 3)
    assert ingest.json_envelopes(spark, str(tmp_path / "many")).count() == n


@pytest.mark.parametrize("name", [
    "restored_state",
    "stream_recovered_state",
    "union_dedup_stream",
    "newest_stream",
])
def test_a_feed_is_landed_once_and_compressed(spark, sf, monkeypatch, name):
    made, real = [], queries.run_dir
    monkeypatch.setattr(queries, "run_dir", lambda *a: made.append(real(*a)) or made[-1])
    queries.QUERIES[name](spark, sf)
    files = [str(f) for d in made for f in Path(d).rglob("part-*.json*")]
    assert files and all(f.endswith(".json.gz") for f in files)
    assert spark.read.schema("op string").json(files).count() == queries.orders_feed(spark, sf).count()
