"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

One scan over the corpus finds every place where an n-gram of a test item stands, and keeps the
words around those places as numbers. Every n-gram is a seed, however common: where one stands and
the words around it hold as many of the item's words as a copy needs, which is a bound on the
alignment's score and loses nothing, they are aligned word by word with the item. A copy may be
edited: the score, as a share of the item's best possible score, decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import ready, saved, table
from changeflow.llm.pieces import distinct, runs

#: Words of a seed; items with fewer words can't be told from ordinary text and match nothing.
WORDS = 4
#: Share of the best possible score from which a passage counts as a copy.
SIMILAR = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of test items that are held in memory at a time; a larger benchmark is worked off in
#: slices, each with its own scan.
ITEM_WORDS = 2_000_000
#: Words kept on each side of a seed, in lengths of the longest item.
AROUND = 1.5


def words_of(texts: pa.Array) -> pa.Array:
    """Lower-case words of letters and digits, as lists; may hold empty words at the ends."""
    return pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}]+")


class Items:
    """A slice of the benchmark as word numbers, with its n-grams."""

    def __init__(self, ids: list, texts: list[str], words: int):
        cut = [[w for w in own if w] for own in words_of(pa.array(texts, pa.large_string())).to_pylist()] if texts else []
        self.words, self.numbers = words, {}
        self.items = []
        for i, own in sorted(zip(ids, cut, strict=True), key=lambda x: (x[0], x[1])):
            if len(own) >= words:
                coded = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in own], np.int64)
                self.items.append((i, coded))
        self.factors = np.random.default_rng(42).integers(1, 1 << 62, words, dtype=np.int64) | 1
        own = [c for _, c in self.items] or [np.zeros(0, np.int64)]
        self.known = np.unique(np.concatenate([self.grams(c) for c in own if len(c)] or own))
        self.sizes = np.array([len(c) for _, c in self.items], np.int64)
        self.longest = max((len(c) for _, c in self.items), default=0)
        # How often which item holds a word, sorted by word.
        number = np.repeat(np.arange(len(self.items)), self.sizes)
        pairs, self.times = np.unique(np.concatenate(own) * max(1, len(self.items)) + number, return_counts=True)
        self.held, self.owner = np.divmod(pairs, max(1, len(self.items)))

    def grams(self, coded: np.ndarray) -> np.ndarray:
        """Hashes of all n-grams of a word sequence."""
        n = len(coded) - self.words + 1
        with np.errstate(over="ignore"):
            return sum(coded[k : k + n] * f for k, f in enumerate(self.factors))

    def grams_at(self, coded: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams at some places."""
        with np.errstate(over="ignore"):
            return sum(coded[places + k] * f for k, f in enumerate(self.factors))

    def found(self, coded: np.ndarray) -> np.ndarray:
        """Places where an n-gram of an item stands (or hashes alike)."""
        n = len(coded) - self.words + 1
        if n <= 0 or not len(self.known):
            return np.zeros(0, np.int64)
        full = coded > 0
        whole = full[:n].copy()
        for k in range(1, self.words):
            whole &= full[k : k + n]
        at = np.flatnonzero(whole)
        grams = self.grams_at(coded, at)
        place = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return at[self.known[place] == grams]

    def sharing(self, words: np.ndarray, share: float) -> np.ndarray:
        """Numbers of the items of which at least this share of the words stand in ``words``.

        An alignment of at least that share of the best score matches as many words or more.
        """
        some, times = np.unique(words[words > 0], return_counts=True)
        first = np.searchsorted(self.held, some)
        size = np.searchsorted(self.held, some, "right") - first
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        same = np.bincount(self.owner[at], np.minimum(self.times[at], np.repeat(times, size)), len(self.items))
        return np.flatnonzero(same >= share * self.sizes - 1e-6)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: its score, and first and last word (inclusive) in ``words``.

    Of equal scores the one that ends first. Unknown words (0) match nothing.
    """
    n, m = len(item), len(words)
    if not n or not m:
        return 0, 0, -1
    scores = np.zeros((n + 1, m + 1), np.int64)
    slide = np.arange(m + 1) * -GAP
    for i in range(1, n + 1):
        hit = np.where((words == item[i - 1]) & (words > 0), MATCH, MISMATCH)
        row = np.zeros(m + 1, np.int64)
        row[1:] = np.maximum(scores[i - 1, :-1] + hit, scores[i - 1, 1:] + GAP)
        np.maximum(row, 0, out=row)
        scores[i] = np.maximum.accumulate(row + slide) - slide
    best = int(scores.max())
    if not best:
        return 0, 0, -1
    ends = scores.max(axis=0)
    last = j = int(np.argmax(ends == best))
    i = int(np.argmax(scores[:, j] == best))
    first = j
    while i and j and scores[i, j] > 0:
        hit = MATCH if words[j - 1] == item[i - 1] and words[j - 1] > 0 else MISMATCH
        if scores[i, j] == scores[i - 1, j - 1] + hit:
            first, i, j = j, i - 1, j - 1
        elif scores[i, j] == scores[i - 1, j] + GAP:
            i -= 1
        else:
            first, j = j, j - 1
    return best, first - 1, last - 1


def _slices(benchmark: DataFrame, id_col: str, text_col: str, words: int, at_once: int) -> Iterator[Items]:
    """The benchmark, a bounded number of words at a time."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-size // at_once))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        got = part.distinct().toArrow()
        yield Items(got["id"].to_pylist(), got["text"].to_pylist(), words)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = WORDS,
    similar: float = SIMILAR,
    at_once: int = ITEM_WORDS,
) -> DataFrame:
    """``(doc_id, mark, item_id, score, first_word, last_word)`` of every passage that copies an item.

    One row per row of ``docs`` and item: the best alignment, its score as a share of the best
    possible one, and the words it covers (from 0, ends inclusive). ``mark`` is a hash of the
    row's text. Null and empty texts match nothing; rows without an id are reported with a null
    id, repeated rows each; ties go to the place that ends first. Without documents or items
    there are no rows.
    """
    spark, out = ready(docs.sparkSession), None
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    picked = picked.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    schema = "doc_id long, mark long, item_id long, score double, first_word long, last_word long"
    for items in _slices(benchmark, item_col, item_text_col, words, at_once):
        if not items.items:
            continue
        shared = spark.sparkContext.broadcast(items)
        places = saved(picked.mapInArrow(_finder(shared), FOUND_DDL), "seeds")
        found = places.mapInArrow(_aligner(shared, similar), schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64())]
    + [(n, pa.list_(pa.int64())) for n in ("grams", "places", "begins")]
    + [("words", pa.list_(pa.list_(pa.int32())))]
)
FOUND_DDL = "doc_id long, mark long, grams array<long>, places array<long>, begins array<long>, words array<array<int>>"


def _finder(shared):
    """Rows with n-grams of items: which, where, and the words around them in stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        reach = int(AROUND * items.longest) + 1
        for batch in batches:
            at = 0
            for _, some in runs(batch.column(2)):
                words, index, bounds = distinct(words_of(some))
                numbers = np.fromiter((items.numbers.get(w, 0) if w else -1 for w in words), np.int64, len(words))
                # Empty words stand only at the ends of a text; they are no words.
                coded = numbers[index]
                real = coded >= 0
                shift = np.concatenate([[0], np.cumsum(real)])
                coded, bounds = coded[real], shift[bounds]
                hits = items.found(coded)
                row = np.searchsorted(bounds, hits, "right") - 1
                inside = hits + items.words <= bounds[row + 1]
                hits, row = hits[inside], row[inside]
                lists: list[list] = [[] for _ in FOUND]
                for r in np.unique(row).tolist():
                    base, end = int(bounds[r]), int(bounds[r + 1])
                    own = hits[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
                    grams = items.grams_at(coded, own)
                    apart = np.flatnonzero(np.diff(own) > 2 * reach)
                    firsts = np.maximum(own[np.concatenate([[0], apart + 1])] - reach, base)
                    lasts = np.minimum(own[np.concatenate([apart, [len(own) - 1]])] + reach, end)
                    record = (
                        batch.column(0)[at + r].as_py(), batch.column(1)[at + r].as_py(), grams, own - base, firsts - base,
                        [coded[a:b].astype(np.int32) for a, b in zip(firsts, lasts, strict=True)],
                    )
                    for values, value in zip(lists, record, strict=True):
                        values.append(value)
                at += len(some)
                if lists[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, type=f.type) for v, f in zip(lists, FOUND, strict=True)], schema=FOUND
                    )

    return run


def _aligner(shared, similar: float):
    """Alignments of the stretches that hold seeds, as good as asked for."""
    names = ["doc_id", "mark", "item_id", "score", "first_word", "last_word"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        # A good alignment spans less: each word it skips costs one, each of the item's brings two.
        span = max(1, int((3 - 2 * min(similar, 1)) * items.longest) + 1)
        for batch in batches:
            lists: list[list] = [[] for _ in names]
            for r in range(batch.num_rows):
                doc_id, mark, grams, places, begins, stretches = (c[r].as_py() for c in batch.columns)
                grams, begins = np.array(grams, np.int64), np.array(begins)
                within = np.searchsorted(begins, places, "right") - 1
                best: dict[int, tuple[int, int, int]] = {}
                for s, stretch in enumerate(stretches):
                    words, seeds = np.array(stretch, np.int64), grams[within == s]
                    seeded: dict[int, bool] = {}
                    for at in range(0, max(1, len(words) - span), span):
                        some = words[at : at + 2 * span]
                        for k in items.sharing(some, similar).tolist():
                            coded = items.items[k][1]
                            if k not in seeded:
                                seeded[k] = bool(np.isin(items.grams(coded), seeds).any())
                            if seeded[k]:
                                score, first, last = align_long(coded, some)
                                if score > best.get(k, (0,))[0]:
                                    begin = int(begins[s]) + at
                                    best[k] = (score, begin + first, begin + last)
                for k, (score, first, last) in sorted(best.items()):
                    item_id, coded = items.items[k]
                    share = score / (MATCH * len(coded))
                    if share >= similar:
                        for values, v in zip(lists, (doc_id, mark, item_id, share, first, last), strict=True):
                            values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(lists, types, strict=True)], names=names)

    return run


def align_long(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """As ``align``, for a stretch of any length: windows that overlap by a whole alignment.

    A local alignment above zero spans at most three item lengths: each skipped word costs one,
    each matched word brings two.
    """
    span = max(1, 3 * len(item))
    best = (0, 0, -1)
    for at in range(0, max(1, len(words) - span), span):
        score, first, last = align(item, words[at : at + 2 * span])
        if score > best[0]:
            best = (score, at + first, at + last)
    return best


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows, with all columns, that hold no copy of a test item."""
    found = leaks(docs, benchmark, id_col, text_col, **how)
    hit = found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
    hit = saved(hit, "leaks")
    whole = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_own_id"), F.xxhash64(F.col(text_col).cast("string")).alias("_own")
    )
    kept = whole.join(hit, F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark")), "left_anti")
    return kept.select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "score", "first_word", "last_word")
