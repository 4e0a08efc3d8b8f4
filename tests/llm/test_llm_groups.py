"""SimHash groups, NN-descent and components, against brute force."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from changeflow.llm import graph, neighbours, simhash


def groups(nodes, linked):
    """Smallest node reachable, by union and find."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    links += [(7, 7), (500, 500), (None, 3), (3, None)]
    real = [x for x in links if None not in x]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == groups({n for x in real for n in x}, real)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(found):
    prints = [brute_print(t) for _, t in found]
    near = [(i, j) for i in range(len(found)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    root = groups(range(len(found)), near)
    least = {}
    for i, (doc_id, _) in enumerate(found):
        if doc_id is not None:
            least[root[i]] = min(least.get(root[i], doc_id), doc_id)
    return [(d, p, least.get(root[i])) for i, ((d, _), p) in enumerate(zip(found, prints, strict=True))]


@pytest.mark.parametrize("text", ["", " \t", "One", "a b", "A b C d É", "x\x0by\x0cz w", "ſ K ß", "a " * 5000])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_print(text)


def flipped(rng, value, most):
    for bit in rng.sample(range(64), rng.randint(0, most)):
        value ^= 1 << bit
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("meeting", [30, 1024])
def test_full_blocks_are_cut_again_without_losing_links(spark, meeting):
    rng = random.Random(meeting)
    centre, other = rng.getrandbits(64), rng.getrandbits(64)
    prints = {flipped(rng, centre, 4) for _ in range(150)} | {flipped(rng, other, 12) for _ in range(60)}
    prints |= {flipped(rng, rng.getrandbits(64), 0) for _ in range(40)}
    found = spark.createDataFrame([(p,) for p in prints], "fp long")
    links = [tuple(r) for r in simhash.near_links(found, meeting).collect()]
    full = (1 << 64) - 1
    near = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & full).bit_count() <= 3]
    assert groups(prints, links) == groups(prints, near)


def test_wide_groups_keep_together():
    rng = random.Random(1)
    fps = np.array(sorted({flipped(rng, 1 << 40, 3) for _ in range(300)}))
    a, b = simhash.linked(np.zeros(len(fps), np.int64), fps)
    near = [(x, y) for x in fps for y in fps if x < y and (int(x ^ y) & (1 << 64) - 1).bit_count() <= 3]
    assert groups(fps.tolist(), zip(a.tolist(), b.tolist())) == groups(fps.tolist(), near)


BASE = "the quick brown fox jumps over the lazy dog and runs through the green wood to its old den " * 12
ODD = [(5, BASE), (3, BASE), (3, BASE), (None, BASE + "now"), (8, None), (6, ""), (7, " \n"), (None, "alone here"), (4, "one two three four")]


def test_groups_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    got = simhash.near_groups(df).collect()
    full = (1 << 64) - 1
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["id"], r["fp"] & full, r["component_id"]) for r in got), key=key) == sorted(brute_groups(ODD), key=key)
    kept = simhash.first_of_groups(df).collect()
    assert kept[0].__fields__ == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 3), (False, 4), (False, 6), (True, 0)]
    none = df.limit(0)
    assert simhash.near_groups(none).count() == simhash.first_of_groups(none).count() == 0


def test_simhash_query(spark, sf):
    found = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in simhash.op2_simhash(spark, sf).collect())
    assert got == sorted((d, f"{p:016x}", c) for d, p, c in brute_groups(found))


# -- vectors -----------------------------------------------------------------------------------


def brute_vectors(found, similar=0.93):
    units = [neighbours.unit(v) for _, v, _ in found]
    near = [
        (i, j)
        for i in range(len(found))
        for j in range(i)
        if units[i] is not None and units[j] is not None and found[i][2] is not None and found[i][2] == found[j][2]
        and len(units[i]) == len(units[j]) and units[i] @ units[j] >= similar
    ]
    root, n = groups(range(len(found)), near), [0] * len(found)
    for i, j in near:
        n[i] += 1
        n[j] += 1
    least = {}
    for i, (vec_id, _, _) in enumerate(found):
        if vec_id is not None:
            least[root[i]] = min(least.get(root[i], vec_id), vec_id)
    return [(v[0], n[i], least.get(root[i]) if units[i] is not None and v[2] is not None else v[0]) for i, v in enumerate(found)]


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    found, made = [], 0
    for size in (1, 2, 3, 40, 300):
        for label in (0, 1):
            centre = rng.standard_normal(32)
            for _ in range(size):
                found.append((made, [float(np.float32(x)) for x in centre + 0.12 * rng.standard_normal(32)], label))
                made += 1
    found += [(made + i, [float(x) for x in rng.standard_normal(32)], i % 3) for i in range(200)]
    odd = [[], None, [0.0] * 32, [None] * 32, [float("nan")] * 32, [float("inf")] * 32, [1.0] * 5]
    found += [(9000 + i, v, 1) for i, v in enumerate(odd)]
    found += [(9100, found[5][1], None), (9101, found[5][1], found[5][2]), (9101, found[5][1], found[5][2]), (None, found[5][1], found[5][2])]
    found += [(9200, [1e300, 1e300], 1), (9201, [1e-300, 1e-300], 1), (9202, [2.0, 2.0], 2)]
    df = spark.createDataFrame(found, "vec_id long, embedding array<double>, label int").withColumn("space", F.lit(1))
    report = {}
    got = neighbours.near_vectors(df, report=report).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = sorted(brute_vectors(found), key=key)
    mine = sorted(((r["id"], r["n_links"], r["component_id"]) for r in got), key=key)
    links, true = sum(r[1] for r in mine), sum(r[1] for r in want)
    assert len(mine) == len(want) and links <= true and links >= 0.98 * true and report["recall"] >= 0.97
    assert sum(a == b for a, b in zip(mine, want, strict=True)) >= 0.98 * len(want)
    assert all(r["kept"] == (r["id"] is not None and r["id"] == r["component_id"]) for r in got)
    none = df.limit(0)
    assert neighbours.near_vectors(none).count() == 0
    lonely = neighbours.near_vectors(spark.createDataFrame([(1, None, 2)], df.drop("space").schema)).collect()
    assert [tuple(r) for r in lonely] == [(1, 0, 1, True)]


def test_dense_groups_are_linked_beyond_full_lists(spark):
    # Cosine 0.99 inside a group of 40, 0.95 across: every list is full of its own group.
    rng = np.random.default_rng(3)
    centres = np.zeros((2, 64))
    centres[0, 0], centres[1, 0], centres[1, 1] = 1, 0.96, (1 - 0.96**2) ** 0.5
    noise = rng.standard_normal((80, 64))
    noise[:, :2] = 0
    noise *= (0.01**0.5) / np.linalg.norm(noise, axis=1)[:, None]
    vectors = np.repeat(centres, 40, axis=0) * 0.99**0.5 + noise
    sims = vectors @ vectors.T
    assert sims[:40, 40:].min() >= 0.935 and sims[:40, :40].min() > sims[:40, 40:].max()
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label string")
    got = neighbours.near_vectors(df).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(79, 0)} and sum(r["kept"] for r in got) == 1


def test_audit_is_not_outvoted_by_a_large_group(spark):
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(32) + 0.05 * rng.standard_normal((300, 32))
    pairs = np.repeat(rng.standard_normal((30, 32)), 2, axis=0) + 0.05 * rng.standard_normal((60, 32))
    made = [(i, 1, i, "x", neighbours.unit(v.tolist()).tobytes()) for i, v in enumerate(np.concatenate([hot, pairs]))]
    reps = spark.createDataFrame(made, "rep long, weight long, least_id long, space string, vec binary")
    all_, some = [(i, 0 if i < 300 else i - i % 2) for i in range(360)], [(i, 0) for i in range(300)]
    told = [neighbours._audit(reps.withColumn("least_id", F.col("least_id") * k + 1 - k // 50), spark.createDataFrame(g, "node long, root long"), 0.93)
            for k, g in ((50, all_), (50, some), (7, some))]
    assert told == [1.0, 0.0, 0.0]


def test_what_draws_miss_is_compared_as_a_whole(spark, monkeypatch):
    def nothing(*_):
        return lambda batches: iter([])

    monkeypatch.setattr(neighbours, "_cells", nothing)
    monkeypatch.setattr(neighbours, "DRAWS", 1)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((3, 32))
    found = [(i, (centres[i % 3 if i < 330 else 2] + 0.05 * rng.standard_normal(32)).tolist(), i // 330) for i in range(700)]
    report = {}
    df = spark.createDataFrame(found, "vec_id long, embedding array<double>, label int")
    got = sorted((r["id"], r["n_links"], r["component_id"]) for r in neighbours.near_vectors(df, report=report).collect())
    assert got == sorted(brute_vectors(found)) and report["whole"]
