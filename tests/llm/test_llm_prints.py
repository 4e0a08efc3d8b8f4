"""Syncmer fingerprints, collocations and Merkle manifests, against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from changeflow.llm import automaton as fsa
from changeflow.llm import collocations, common, merkle, order, syncmers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, vocabulary=40):
    rng = random.Random(seed)
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


def table(spark, tmp_path, found, schema=SCHEMA):
    """A folder with a documents table, in several files."""
    spark.createDataFrame(found, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# -- fingerprints ------------------------------------------------------------------------

BREAKS = re.compile("[ \t\n\x0b\f\r]+|(?<=[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ud7ff\uf900-\uffef])")


def chained(found):
    h = 42
    for w in found:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def brute_anchors(text):
    w = [x for x in BREAKS.split(text or "") if x]
    inner = [chained(w[i : i + 2]) for i in range(len(w) - 1)]
    out = [
        chained(w[j : j + 5]) & 0xFFFFFFFF
        for j in range(len(w) - 4)
        if min(inner[j : j + 4]) in (inner[j], inner[j + 3])
    ]
    out = [x for i, x in enumerate(out) if i == 0 or x != out[i - 1]]
    return out or ([chained([text]) & 0xFFFFFFFF] if text else [])


def brute_likeness(a, b):
    ranks = []
    for found in (a, b):
        seen, own = Counter(), {}
        for i, x in enumerate(found):
            own[x, seen[x]] = i
            seen[x] += 1
        ranks.append(own)
    left, right = ranks
    shifts = Counter(right[x] - left[x] for x in left if x in right)
    shared = sum(shifts.values()) if min(len(left), len(right)) == 1 else sum(n for n in shifts.values() if n > 1)
    total = len(left) + len(right)
    return 1.0 if not total else shared / (total - shared)


TEXTS = [
    None, "", " ", "\n\t", "one", "a b c d", "a b c d e", "x " * 300, words(1, 200), words(2, 90) + " Ünïcode 日本語の文章です " + words(3, 30),
    words(1, 200), "漢字" * 40, "🙂" * 30, "𠀀𠀁" * 20, words(4, 6000), "no-space" * 4000, words(1, 100) + " inserted " + words(1, 200)[400:],
]


def test_anchors_are_those_of_the_definition(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = dict(df.select("doc_id", syncmers.anchors(F.col("text"))).collect())
    assert got == {i: brute_anchors(t) for i, t in enumerate(TEXTS)}
    assert not re.search("Python|ArrowEval", df.select(syncmers.anchors(F.col("text")))._jdf.queryExecution().toString())
    # One in any eight windows at least, wherever they stand: a passage keeps its anchors in other surroundings.
    long = brute_anchors(words(4, 6000))
    inside = brute_anchors(words(9, 50) + " " + words(4, 6000) + " " + words(8, 50))
    assert len(long) > 6000 / 8 and set(long) <= set(inside)


def brute_prints(found):
    """Rows of the query, for ``(doc_id, text)``."""
    found = sorted(((d, t or "") for d, t in found), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()))
    out = []
    for i, (d, t) in enumerate(found):
        following = found[(i + 1) % len(found)][1]
        tail = len(t) // 4
        edited = t[: len(t) - tail] + following[:tail]
        a, b, c = map(brute_anchors, (t, edited, following))
        text = lambda x: base64.b64encode(np.array(x, ">u4").tobytes()).decode()
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), brute_likeness(a, b), brute_likeness(a, c)))
    return sorted(out, key=str)


def test_fingerprint_query(spark, tmp_path, sf):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)]
    rows += [(3, " ", "de", "s", 1), (8, words(1, 200), None, None, None), (8, words(1, 200), "x", "y", 2), (None, "null id", "en", "s", 1), (None, None, "en", "s", 1)]
    sf2 = table(spark, tmp_path, rows)
    got = sorted(map(tuple, syncmers.op11_syncmers(spark, sf2).collect()), key=str)
    assert got == brute_prints([r[:2] for r in rows])
    alone = table(spark, tmp_path / "one", rows[8:9])
    assert [(r.near_edited, r.near_next) for r in syncmers.op11_syncmers(spark, alone).collect()][0][1] == 1.0
    assert syncmers.op11_syncmers(spark, table(spark, tmp_path / "none", [])).count() == 0
    whole = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert sorted(map(tuple, syncmers.op11_syncmers(spark, sf).collect()), key=str) == brute_prints(whole)


def test_no_python_on_the_way(spark, sf):
    text = syncmers.op11_syncmers(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text)


# -- collocations ------------------------------------------------------------------------


def brute_phrases(found, least=10, cover=50):
    counts, whole = {}, Counter()
    for lang, text in found:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            whole[lang] += len(w)
            own.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        kept = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in kept.items():
            for part in {p[:2], p[1:]} if len(p) == 3 else ():
                longest[part] = max(longest[part], a)
        for p, a in kept.items():
            if not (len(p) == 2 and longest[p] and 100 * longest[p] >= cover * a):
                score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                out.append((lang, " ".join(p), a, own[p[:k]], own[p[k:]], whole[lang], score))
    return sorted(out)


PHRASES = [
    ("en", "New York is big. new york! NEW\tYORK, new  york; in new york: a new\nyork " * 6),
    ("en", words(5, 3000, 12)), ("en", words(5, 3000, 12)), ("de", words(6, 500, 5) + ".." + " x" * 50), (None, "a a a a a a a a a a a a"),
    ("und", "a a b"), ("fr", None), ("fr", ""), ("fr", " .,;\r\n "), ("l\tb \"x", "é è é è " * 12), ("fr", "\x00 \x01 " * 11), ("it", "z" * 5000 + " q" * 20),
]


@pytest.mark.parametrize("per_range", [25, 300, 10**6])
def test_collocations(spark, per_range):
    df = spark.createDataFrame([(a, b, "extra") for a, b in PHRASES * 2], "lang string, text string, phrase string").repartition(4)
    got = collocations.collocations(df, per_range=per_range)
    assert sorted(map(tuple, got.select("lang", "phrase", "a", "l", "r", "n", "score").collect())) == brute_phrases(PHRASES * 2)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(df.where("lang = 'fr'"), least=100).count() == 0


def test_rounds_of_unions(spark, monkeypatch):
    """Many small shards, united in more than one round."""
    monkeypatch.setattr(collocations, "FAN", 3)
    df = spark.createDataFrame([("en" if i % 2 else "de", words(i, 120, 9)) for i in range(60)], "lang string, text string").repartition(12)
    got = collocations.collocations(df, per_range=100)
    want = brute_phrases([tuple(r) for r in df.collect()])
    assert sorted(map(tuple, got.select("lang", "phrase", "a", "l", "r", "n", "score").collect())) == want


def test_long_texts_and_large_counts(spark):
    one = words(3, 900_000, 30)
    df = spark.createDataFrame([("en", one)], "lang string, text string")
    got = collocations.collocations(df).select("lang", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == brute_phrases([("en", one)])
    # Products of three counts pass 64 bits; the expression that divides them is exact.
    big = spark.sql("SELECT CAST(99999999999999 AS DECIMAL(14,0)) AS a").selectExpr("(a * a * CAST(1000000 AS DECIMAL(7,0))) div (a * a) AS s")
    assert big.first()[0] == 10**6


def held_most(run):
    """What ``run`` returns, and the most bytes that its arrays and objects took at once."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_shards_and_unions():
    """A shard is closed, and slices are united and cut again, in few bytes an n-gram."""

    def shard(seed):
        out = collocations._Shard()
        text = " ".join(f"w{w}" for w in np.random.default_rng(seed).integers(0, 3000, 60_000))
        assert not list(out.add(*collocations._steps(["en"], pa.array([text], pa.large_string()))))
        return out

    made = [held_most(shard(i).close) for i in range(6)]
    assert all(most < 80 * n for (_, n, _), most in made)
    blobs, sizes, keys = zip(*(x for x, _ in made), strict=True)
    bounds = sorted(map(tuple, keys[0]))[8::16]
    group = pa.table({"range": pa.array([0] * 6, pa.int64()), "counts": pa.array(blobs, pa.binary())})
    united, most = held_most(lambda: collocations._union(10, bounds, 4, 1)(group))
    assert united.num_rows == 4 and most < 80 * sum(sizes)


def test_large_rows_are_stored_apart(spark, monkeypatch):
    """Rows of megabytes don't wait for a hundred of them before a row group ends, and aren't compressed twice."""
    metas = []

    def saved(df, name, **options):
        out = common.saved(df, name, **options)
        if name in ("shards", "ranges", "rows"):
            metas.extend(pq.ParquetFile(f.removeprefix("file:")).metadata for f in out.inputFiles())
        return out

    monkeypatch.setattr(collocations, "saved", saved)
    assert collocations.collocations(spark.createDataFrame([("en", words(1, 1000))], "lang string, text string")).count()
    stored = [m.row_group(i).column(0).compression for m in metas for i in range(m.num_row_groups)]
    assert stored and set(stored) == {"UNCOMPRESSED"}
    metas.clear()
    large = spark.range(0, 48, 1, 1).selectExpr("unhex(repeat(sha2(string(id), 512), 16384)) AS counts")
    saved(large, "rows", options=common.LARGE_ROWS)
    (meta,) = metas
    assert meta.num_rows == 48 and max(meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)) < 20 << 20


def brute_trie(paths):
    return {p: n for p, n in paths.items() if n}


def as_dict(trie, names):
    out = {}
    for depth in range(1, len(trie) + 1):
        for path, w in zip(zip(*(c.tolist() for c in fsa.spelled(trie, depth)), strict=True), trie[depth - 1][2].tolist(), strict=True):
            if w:
                out[tuple(names[x] for x in path)] = w
    return out


def transducer(paths):
    names = sorted({x for p in paths for x in p})
    rank = {x: i for i, x in enumerate(names)}
    depth = np.array([len(p) for p in paths])
    columns = [np.array([rank[p[k]] if k < len(p) else 0 for p in paths]) for k in range(depth.max())]
    trie = fsa.from_paths(columns, depth, np.array(list(paths.values())), len(names))
    return fsa.Transducer.of(trie, pa.array(names, pa.large_string()))


@pytest.mark.parametrize("seed", range(8))
def test_automata(seed):
    rng = random.Random(seed)

    def language(n):
        return {tuple(rng.choice("abcdé") for _ in range(rng.randint(1, 4))): rng.randint(1, 3) for _ in range(n)}

    one, two = language(60), language(40)
    a, b = (fsa.Transducer.from_bytes(transducer(x).to_bytes()) for x in (one, two))
    assert as_dict(a.trie(), a.symbols.to_pylist()) == one
    # Minimal: no two states of a level have the same arcs.
    for bounds, label, weight, target in a.states:
        arcs = [tuple(zip(label[i:j].tolist(), weight[i:j].tolist(), target[i:j].tolist(), strict=True)) for i, j in zip(bounds[1:], bounds[2:])]
        assert len(set(arcs)) == len(arcs)
    symbols, tries = fsa.shared_labels([a, b])
    names = symbols.to_pylist()
    assert as_dict(fsa.merged(tries, len(names)), names) == dict(Counter(one) + Counter(two))
    assert as_dict(fsa.merged(tries, len(names), np.maximum), names) == dict(Counter(one) | Counter(two))
    assert as_dict(fsa.pruned(tries[0], 2), names) == {p: n for p, n in one.items() if n >= 2}
    assert as_dict(fsa.walked(tries[1], tries[0], len(names)), names).items() >= {p: one[p] for p in two if p in one}.items()
    # Slices at any bounds hold everything once.
    full = sorted(p for p in one if len(p) == 4)[::3]
    trie = a.trie()
    ends = [[0, *e, len(x[0])] for e, x in zip(fsa.cuts(trie, a.symbols.to_pylist(), full), trie, strict=True)]
    parts = [as_dict(fsa.sliced(trie, [e[r] for e in ends], [e[r + 1] for e in ends]), a.symbols.to_pylist()) for r in range(len(full) + 1)]
    assert sum(map(Counter, parts), Counter()) == Counter(one) and sum(map(len, parts)) == len(one)
    for low, high, part in zip([(), *full], [*full, ("\U0010ffff",)], parts, strict=True):
        assert all(low <= p < high for p in part)


# -- manifests ---------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(row):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def levels_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def steps_of(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 8
        out.append(("".join(level[first:i]), "".join(level[i + 1 : first + 8])))
        i //= 8
    return out


def brute_manifest(found):
    """Rows of the query for ``(doc_id, text, lang, source, n_chars)``."""
    groups = {}
    for d, text, lang, source, n in found:
        leaf = digest(framed((d, source, lang, n, text)))
        given = leaf
        if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and text is not None:
            given = digest(framed((d, source, lang, n, re.sub("[A-Z]", lambda m: m[0].lower(), text))))
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf, given, d))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels_of([g[2] for g in sorted(groups[x])]) for x in names}
    top = levels_of([trees[x][-1][0] for x in names])
    out = []
    for j, x in enumerate(names):
        for i, (_, _, leaf, given, d) in enumerate(sorted(groups[x])):
            steps, h = steps_of(trees[x], i) + steps_of(top, j), given
            for before, after in steps:
                h = digest(before + h + after)
            out.append((d, leaf, trees[x][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), h, h == top[-1][0]))
    return sorted(out, key=str)


def manifest_rows(n, langs):
    rng = random.Random(n)
    return [
        (i, rng.choice([None, "", "Aa Bb", "ß ſ K plain", words(i, 5)]), rng.choice(langs), rng.choice([None, "s", "-"]), rng.choice([None, i]))
        for i in rng.sample(range(-50, 5000), n)
    ]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, ["en"]), (9, [None]), (130, ["en", "en", "en", None, "", "=", "é", "zz"]), (70, [f"l{i}" for i in range(30)])])
def test_manifest_query(spark, tmp_path, n, langs):
    rows = manifest_rows(n, langs)
    # Repeated rows, one id in several groups, null ids.
    rows += rows[:3] + [(rows[0][0], "Other", langs[-1], "t", 1), (None, "X", langs[0], None, None), (None, None, langs[0], None, None)]
    assert sorted(map(tuple, merkle.op13_manifest(spark, table(spark, tmp_path, rows)).collect()), key=str) == brute_manifest(rows)


def test_manifest_edges(spark, tmp_path):
    assert merkle.op13_manifest(spark, table(spark, tmp_path / "none", [])).count() == 0
    alone = [(7, "x" * 300_000 + "Y", None, None, None)]
    assert list(map(tuple, merkle.op13_manifest(spark, table(spark, tmp_path / "one", alone)).collect())) == brute_manifest(alone)
    # Extra columns with the names used inside, and most rows equal.
    df = spark.createDataFrame([(1, "same", "en", "s", 4)] * 40 + manifest_rows(9, ["en", "de"]), SCHEMA)
    df = df.withColumns({c: F.lit("?") for c in ("id", "tree", "place", "h", "n", "leaf", "root", "group", "_at", "_part")})
    found = merkle.manifest(df).withColumn("up", merkle.folded(F.col("leaf"), F.col("steps")))
    assert found.count() == 49 and found.where("up <> root OR root IS NULL").count() == 0
    assert found.select("root").distinct().count() == 1


def test_numbers_follow_the_order(spark):
    rng = random.Random(2)
    found = [(rng.choice(["a", "b", ""]), rng.choice([None, 1, 2, 3]), rng.random()) for _ in range(300)] + [("hot", 5, 0.5)] * 200
    df = spark.createDataFrame(found, "k string, a int, b double").repartition(7)
    got = order.numbered(df, ["a", "b"], "n", ["k"]).collect()
    for key in ("a", "b", "", "hot"):
        own = sorted((r for r in got if r["k"] == key), key=lambda r: r["n"])
        assert [r["n"] for r in own] == list(range(len(own)))
        assert [(r["a"] or 0, r["b"]) for r in own] == sorted((a or 0, b) for k, a, b in found if k == key)
    assert order.numbered(df.limit(0), ["a"], "n").count() == 0
