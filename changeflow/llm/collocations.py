"""Phrases whose words belong together, by weighted acyclic automata of n-gram counts.

Shards of the texts become minimal count transducers, built from their sorted n-grams; the language
is the first label. They are cut at common bounds, and each prefix range unites what all shards
hold of it, weights summed, in rounds: a round unites up to FAN slices and cuts them into as many finer
ranges, so that slices keep their size however many shards there are. The parts of candidates lie anywhere: what is asked of a range becomes
an automaton, too, and its composition with the range's counts gives their numbers.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeflow.llm import automaton as fsa
from changeflow.llm.automaton import Transducer
from changeflow.llm.common import LARGE_ROWS, saved, table
from changeflow.llm.pieces import distinct, runs

WORDS = 3
#: Word places of a shard, and distinct words after which it is closed early.
SHARD, SYMBOLS = 400_000, 1_000_000
#: n-grams of all shards that a prefix range should hold; bounds are read off a sample of about
#: SAMPLE n-grams of the shards. Both only balance the work.
RANGE, SAMPLE, KEYS = 600_000, 200_000, 64
#: At most so many slices are cut from a transducer in a round, and about so many united.
FAN = 32
#: Bytes of text that are cut into words at a time.
AT_ONCE = 1 << 20
STOPS = "[.,;:!?\\x0A-\\x0D]"


def _steps(langs: list[str], texts: pa.Array) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Words of a run of texts: labels (languages and words), then per word place the language, the word
    and the following words, and how many labels the longest phrase from there reads."""
    low = pc.replace_substring(pc.ascii_lower(texts), "\t", " ")
    low = pc.replace_substring_regex(low, STOPS, " . ")
    words, index, bounds = distinct(pc.split_pattern(low, " "))
    where = {w: i for i, w in enumerate(words)}
    stop = index == where.get(".", -1)
    opens = stop.copy()
    opens[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    real = ~stop & (index != where.get("", -1))
    piece = np.cumsum(opens)[real]
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))[real]
    word = index[real].astype(np.int64)

    distinct_langs = sorted(set(langs))
    number = {x: len(words) + i for i, x in enumerate(distinct_langs)}
    columns = [np.array([number[x] for x in langs], np.int64)[row]]
    depth = np.full(len(word), 1, np.int64)
    for k in range(WORDS):
        ahead = np.zeros(len(word), np.int64)
        ahead[: len(word) - k] = word[k:]
        inside = np.zeros(len(word), bool)
        inside[: len(word) - k] = piece[k:] == piece[: len(word) - k]
        columns.append(ahead)
        depth += inside
    return words + distinct_langs, columns, depth


class _Shard:
    """Word places until a transducer is made of them."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.held: list[tuple[list[np.ndarray], np.ndarray]] = []
        self.places = 0

    def add(self, labels: list[str], columns: list[np.ndarray], depth: np.ndarray) -> Iterator[tuple]:
        for at in range(0, len(depth), SHARD):
            part = slice(at, at + SHARD)
            cut = [c[part] for c in columns]
            flags = np.zeros(len(labels), bool)
            for c in cut:
                flags[c] = True
            used = np.flatnonzero(flags)
            place = np.zeros(len(labels), np.int32)
            place[used] = [self.known.setdefault(labels[i], len(self.known)) for i in used.tolist()]
            self.held.append(([place[c] for c in cut], depth[part].astype(np.int8)))
            self.places += len(cut[0])
            if self.places >= SHARD or len(self.known) >= SYMBOLS:
                yield self.close()

    def close(self) -> tuple:
        """``(transducer, number of n-grams, some of them)``; the shard is empty again."""
        symbols, held = pa.array(list(self.known), pa.large_string()), self.held
        self.__init__()
        order = pc.sort_indices(symbols).to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        columns = [rank[np.concatenate(c)] for c in zip(*(h[0] for h in held), strict=True)]
        depth = np.concatenate([h[1] for h in held])
        symbols = symbols.take(pa.array(order))
        held.clear()
        trie = fsa.from_paths(columns, depth, np.ones(len(depth), np.int64), len(order), every=True)
        del columns, depth
        keys = []
        if len(trie) > WORDS:
            spread = np.unique(np.linspace(0, len(trie[WORDS][0]) - 1, KEYS).astype(np.int64))
            full = fsa.spelled(trie, WORDS + 1, spread)
            keys = [[symbols[int(x)].as_py() for x in path] for path in zip(*full, strict=True)]
        return Transducer.of(trie, symbols).to_bytes(), sum(len(x) for _, x, _ in trie), keys


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = _Shard()
    made = lambda row: pa.RecordBatch.from_arrays(
        [pa.array([row[0]], pa.binary()), pa.array([row[1]], pa.int64()), pa.array([row[2]], pa.list_(pa.list_(pa.string())))],
        names=["counts", "n_grams", "keys"],
    )
    for batch in batches:
        for at, texts in runs(batch.column(1), AT_ONCE):
            langs = batch.column(0).slice(at, len(texts)).to_pylist()
            for row in shard.add(*_steps(langs, texts)):
                yield made(row)
    if shard.places:
        yield made(shard.close())


def _bounds(shards: DataFrame, per_range: int) -> list[tuple[str, ...]]:
    """Where ranges end: n-grams that cut a sample of all into equal parts."""
    total, n = shards.agg(F.coalesce(F.sum("n_grams"), F.lit(0)), F.count(F.lit(1))).first()
    every = n * KEYS // SAMPLE + 1
    keys = shards.select(F.explode("keys").alias("key")).where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0)
    found = sorted(tuple(r[0]) for r in keys.collect())
    # As many ranges as shards at least: what a round unites then is about as large as a shard.
    ranges = min(max(total // per_range + 1, n), len(found) + 1)
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)})


def _cut(
    trie: fsa.Trie, symbols: pa.Array, coarse: int, bounds: list[tuple[str, ...]], fan: int, width: int
) -> Iterator[pa.RecordBatch]:
    """Transducers of slices of range ``coarse``, one for each of the ``fan`` finer ranges in it.

    A finer range is ``width`` of the ranges between ``bounds``.
    """
    first = coarse * fan
    inner = [bounds[k * width - 1] for k in range(first + 1, first + fan) if k * width <= len(bounds)]
    ends = fsa.cuts(trie, symbols.to_pylist(), inner)
    ends = [[0, *e, len(level[0])] for e, level in zip(ends, trie, strict=True)]
    for r in range(len(inner) + 1):
        part = fsa.sliced(trie, [e[r] for e in ends], [e[r + 1] for e in ends])
        if part:
            yield _row(first + r, Transducer.of(part, symbols))


def _cut_shards(bounds: list[tuple[str, ...]], fan: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                symbols, (trie,) = fsa.shared_labels([Transducer.from_bytes(data.as_py())])
                yield from _cut(trie, symbols, 0, bounds, fan, width)

    return run


def _row(number: int, transducer: Transducer) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([transducer.to_bytes()], pa.binary())], names=["range", "counts"]
    )


def _union(least: int, bounds: list[tuple[str, ...]], fan: int, width: int):
    """Slices of a range united, weights summed: cut again into finer ranges while there are any
    (``width``), else without n-grams under ``least``.
    """

    def run(group: pa.Table) -> pa.Table:
        symbols, tries = fsa.shared_labels([Transducer.from_bytes(x.as_py()) for x in group.column("counts")])
        whole, at = fsa.merged(tries, len(symbols)), group.column("range")[0].as_py()
        del tries
        if width:
            return pa.Table.from_batches(_cut(whole, symbols, at, bounds, fan, width))
        return pa.Table.from_batches([_row(at, Transducer.of(fsa.pruned(whole, least), symbols))])

    return run


def _united(shards: DataFrame, bounds: list[tuple[str, ...]], least: int) -> DataFrame:
    """``(range, counts)``: what all shards hold of each range; n-grams under ``least`` in total can't
    matter to any score and are left out at the end.
    """
    n = shards.count()
    most, rounds, fan = max(n, len(bounds) + 1), 1, 1
    while FAN**rounds < most:
        rounds += 1
    while fan**rounds < most:
        fan += 1
    kind = "range long, counts binary"
    level = shards.select("counts").mapInArrow(_cut_shards(bounds, fan, fan ** (rounds - 1)), kind)
    for left in reversed(range(rounds)):
        lots = max(1, -(-n // fan ** (rounds - left)))
        lot = F.pmod(F.xxhash64("counts"), F.lit(lots)).alias("lot")
        united = _union(least, bounds, fan, fan ** (left - 1) if left else 0)
        level = level.select("range", lot, "counts").groupBy("range", "lot").applyInArrow(united, kind)
    return level


CANDIDATE = "lang string, phrase string, words array<string>, a long"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of two words or more that a range kept."""
    for batch in batches:
        for data in batch.column(0):
            counts = Transducer.from_bytes(data.as_py())
            trie, names = counts.trie(), counts.symbols.cast(pa.string())
            for depth in range(3, len(trie) + 1):
                on = np.flatnonzero(trie[depth - 1][2])
                for at in range(0, len(on), 100_000):
                    rows = on[at : at + 100_000]
                    lang, *words = (names.take(pa.array(c[rows])) for c in fsa.spelled(trie, depth))
                    each = np.arange(len(rows) + 1, dtype=np.int32) * len(words)
                    order = np.arange(len(rows) * len(words)).reshape(len(words), -1).T.ravel()
                    listed = pa.ListArray.from_arrays(pa.array(each), pa.concat_arrays(words).take(pa.array(order)))
                    yield pa.RecordBatch.from_arrays(
                        [lang, pc.binary_join(listed, " "), listed, pa.array(trie[depth - 1][2][rows], pa.int64())],
                        names=["lang", "phrase", "words", "a"],
                    )


def _ranged(bounds: list[tuple[str, ...]]):
    """The range in which a phrase of a language stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, parts = (batch.column(i).to_pylist() for i in range(2))
            found = [bisect_right(bounds, (x, *(p.split(" ") if p else ()))) for x, p in zip(langs, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *batch.columns], names=["range", "lang", "part", "longest"])

    return run


def _composed(left: pa.Table, right: pa.Table) -> pa.Table:
    """What a range is asked for, composed with its counts: ``(lang, part, longest, places)``."""
    fields: list[list] = [[], [], [], []]
    if left.num_rows and right.num_rows:
        paths = [(x, *(p.split(" ") if p else ())) for x, p in zip(right.column("lang").to_pylist(), right.column("part").to_pylist(), strict=True)]
        symbols = pa.array(sorted({x for p in paths for x in p}), pa.large_string())
        rank = {x: i for i, x in enumerate(symbols.to_pylist())}
        depth = np.array([len(p) for p in paths])
        columns = [np.array([rank[p[k]] if k < len(p) else 0 for p in paths], np.int64) for k in range(depth.max())]
        weight = np.array(right.column("longest").to_pylist(), np.int64) + 1
        asked = Transducer.of(fsa.from_paths(columns, depth, weight, len(symbols)), symbols)
        counts = Transducer.from_bytes(left.column("counts")[0].as_py())
        symbols, (known, want) = fsa.shared_labels([counts, asked])
        names = symbols.to_pylist()
        for d, ((_, _, places), (_, _, asked_for)) in enumerate(zip(fsa.walked(want, known, len(names)), want, strict=True), 1):
            on = np.flatnonzero(asked_for)
            lang, *words = (c[on].tolist() for c in fsa.spelled(want, d))
            fields[0] += [names[x] for x in lang]
            fields[1] += [" ".join(names[x] for x in p) for p in zip(*words, strict=True)] if words else [""] * len(lang)
            fields[2] += (asked_for[on] - 1).tolist()
            fields[3] += places[on].tolist()
    types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.table([pa.array(v, t) for v, t in zip(fields, types, strict=True)], names=["lang", "part", "longest", "places"])


def collocations(
    docs: DataFrame,
    least: int = 10,
    cover: int = 50,
    text_col: str = "text",
    lang_col: str = "lang",
    per_range: int = RANGE,
) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` of the phrases of two or three words that stay.

    Words are what spaces and tabs leave of the pieces between ``.,;:!?`` and line ends, A-Z in lower
    case; everything is counted per language (null: ``und``). A phrase with ``a >= least`` places is a
    candidate; ``l`` and ``r`` are the places of the two parts of its weakest cut, ``score`` is
    ``floor(1000000 a a / (l r))`` there, the first such cut on ties. A candidate inside a longer one that
    has ``cover`` percent of its places or more is dropped. ``n`` counts all words of the language.

    Null and empty texts and texts of stops alone have no words; repeated rows count again. No rows,
    or no phrase often enough, give no rows. Ties have no part in the result beyond the cut. Long
    texts are cut into shards wherever one is full, since phrases are counted by where they begin.
    Other columns of ``docs`` play no part.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    shards = saved(texts.mapInArrow(_shards, "counts binary, n_grams long, keys array<array<string>>"), "shards", options=LARGE_ROWS)
    bounds = _bounds(shards, per_range)
    ranges = saved(_united(shards, bounds, least), "ranges", options=LARGE_ROWS)
    found = saved(ranges.select("counts").mapInArrow(_candidates, CANDIDATE), "candidates")
    # Every cut of a candidate, and the whole of its language, ask for their places; a part is asked for once.
    cut = "inline(transform(sequence(1, size(words) - 1), k -> struct(k, array_join(slice(words, 1, k), ' ') AS head, array_join(slice(words, k + 1, size(words)), ' ') AS tail)))"
    cuts = found.select("lang", "phrase", "a", F.expr(cut))
    parts = found.select("lang", F.lit("").alias("part"), F.lit(0).cast("long").alias("longest")).unionByName(
        cuts.select("lang", "a", F.explode(F.array("head", "tail")).alias("part")).select(
            "lang", "part", F.when(F.contains("part", F.lit(" ")), F.col("a")).otherwise(0).alias("longest")
        )
    )
    asked = parts.groupBy("lang", "part").agg(F.max("longest").alias("longest"))
    asked = asked.mapInArrow(_ranged(bounds), "range long, lang string, part string, longest long")
    places = saved(
        ranges.groupBy("range")
        .cogroup(asked.groupBy("range"))
        .applyInArrow(_composed, "lang string, part string, longest long, places long"),
        "places",
    )
    of = lambda part, name: places.select("lang", F.col("part").alias(part), F.col("places").alias(name))
    # Three counts under 10^14 keep every product within 38 digits.
    exact = lambda c: F.col(c).cast("decimal(14,0)")
    million = exact("a") * exact("a") * F.lit(1_000_000).cast("decimal(7,0)")
    scored = (
        cuts.join(of("head", "l"), ["lang", "head"])
        .join(of("tail", "r"), ["lang", "tail"])
        .select("lang", "phrase", "a", "k", "l", "r", million.alias("million"), (exact("l") * exact("r")).alias("both"))
        .select("lang", "phrase", "a", F.struct(F.expr("million div both").alias("score"), "k", "l", "r").alias("cut"))
        .groupBy("lang", "phrase", "a")
        .agg(F.min("cut").alias("best"))
    )
    longer = places.select("lang", F.col("part").alias("phrase"), "longest")
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longest").isNull() | (F.col("longest") == 0) | (F.col("longest") * 100 < F.col("a") * cover)
    )
    whole = places.where("part = ''").select("lang", F.col("places").alias("n"))
    return kept.join(whole, "lang").select(
        "lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")
    )


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents"))
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(first).cast("long")).where("rank <= 2000")
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
