"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces (a forward pass); a text's is the
product over its words. The probabilities are learnt by expectation maximisation on a bounded
sample of labelled documents: the backward pass gives each piece's expected count.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import SLICE, ready, saved, table
from changeflow.llm.pieces import SPACE, distinct, runs, summed, vocabulary

UNKNOWN = "und"
#: Labelled documents to learn from, of each language, about; and rounds of learning.
SAMPLE, ROUNDS = 1500, 3
#: Added to every expected count; probability of a letter that is no piece.
SMOOTH, STRANGE = 0.05, 1e-7
#: A letter's usual probability: scores are kept as multiples of it, so that they don't vanish.
SCALE = 20.0
#: Longer words are read in stretches of this many letters.
STRETCH = 64
#: Words cut into pieces at a time.
AT_ONCE = 10_000
#: Words whose scores a worker keeps, and how often a run of texts must hold them.
KEPT, OFTEN = 100_000, 3


@dataclass(frozen=True)
class Model:
    """Languages, and the probability of each piece (row) in each language (column)."""

    languages: tuple[str, ...]
    chances: np.ndarray


@functools.lru_cache(maxsize=2)
def matcher(path: str | None = None) -> tuple[ahocorasick.Automaton, int, frozenset]:
    """Automaton of the lower-case letter pieces, their number, and the single letters."""
    found, single = ahocorasick.Automaton(), set()
    for piece in vocabulary(path)[0]:
        bare = piece.removeprefix(SPACE)
        if (bare.isalpha() and bare == bare.lower()) or piece == SPACE:
            found.add_word(piece, (len(found), len(piece)))
            if len(piece) == 1:
                single.add(piece)
    found.make_automaton()
    return found, len(found), frozenset(single)


def matches(words: list[str], path: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every piece found in every word: the word, the piece, where it starts and ends; by end.

    A letter that is no piece counts as the piece after the last one.
    """
    found, n, single = matcher(path)
    which, piece, start, end = [], [], [], []
    for w, word in enumerate(words):
        for last, (number, length) in found.iter(word):
            which.append(w)
            piece.append(number)
            start.append(last + 1 - length)
            end.append(last + 1)
        if not single.issuperset(word):
            for at, char in enumerate(word):
                if char not in single:
                    which.append(w)
                    piece.append(n)
                    start.append(at)
                    end.append(at + 1)
    which, piece, start, end = (np.array(x, np.int32) for x in (which, piece, start, end))
    order = np.argsort(end, kind="stable")
    return which[order], piece[order], start[order], end[order]


def stretches(word: str) -> list[str]:
    """The word behind its space mark, in readable stretches."""
    word = SPACE + word
    return [word[at : at + STRETCH] for at in range(0, len(word), STRETCH)]


def _add(sums: np.ndarray, to: np.ndarray, values: np.ndarray) -> None:
    """Adds rows of values to rows of sums; equal targets stand together."""
    firsts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    sums[to[firsts]] += np.add.reduceat(values, firsts, axis=0)


def _forward(words: list[str], chances: np.ndarray, path: str | None) -> tuple:
    """Scaled forward sums: one row per place in a word, one column per language."""
    which, piece, start, end = found = matches(words, path)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    places = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    sums = np.zeros((int(lengths.sum()) + len(words), chances.shape[1]))
    sums[places] = 1.0
    scaled = chances[piece] * (SCALE ** (end - start))[:, None]
    cuts = np.searchsorted(end, np.arange(1, (int(lengths.max()) if len(words) else 0) + 2))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            _add(sums, places[which[a:b]] + end[a:b], sums[places[which[a:b]] + start[a:b]] * scaled[a:b])
    return found, lengths, places, scaled, sums


def log_chances(words: list[str], chances: np.ndarray, path: str | None = None) -> np.ndarray:
    """Log probability of each word (row) in each language (column)."""
    if len(words) > AT_ONCE:
        cuts = range(0, len(words), AT_ONCE)
        return np.concatenate([log_chances(words[at : at + AT_ONCE], chances, path) for at in cuts])
    if not words:
        return np.zeros((0, chances.shape[1]))
    parts = [stretches(w) for w in words]
    flat = [p for own in parts for p in own]
    _, lengths, places, _, sums = _forward(flat, chances, path)
    logs = np.log(np.maximum(sums[places + lengths], 1e-300)) - (lengths * np.log(SCALE))[:, None]
    firsts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])[:-1]
    return np.add.reduceat(logs, firsts, axis=0)


def expected(words: list[str], counts: np.ndarray, chances: np.ndarray, path: str | None = None) -> np.ndarray:
    """Expected number of uses of each piece (row) in each language (column).

    ``counts`` says how often each word occurs in each language.
    """
    if len(words) > AT_ONCE:
        cuts = range(0, len(words), AT_ONCE)
        return sum(expected(words[at : at + AT_ONCE], counts[at : at + AT_ONCE], chances, path) for at in cuts)
    out = np.zeros_like(chances)
    parts = [stretches(w) for w in words]
    flat = [p for own in parts for p in own]
    if not flat:
        return out
    weights = np.repeat(counts, [len(p) for p in parts], axis=0)
    (which, piece, start, end), lengths, places, scaled, sums = _forward(flat, chances, path)
    back = np.zeros_like(sums)
    back[places + lengths] = 1.0
    # Backwards: pieces by falling start.
    order = np.lexsort((which, -start))
    falling = start[order]
    cuts = np.flatnonzero(np.concatenate([[True], falling[1:] != falling[:-1], [True]])) if len(falling) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        some = order[a:b]
        _add(back, places[which[some]] + start[some], back[places[which[some]] + end[some]] * scaled[some])
    total = np.maximum(sums[places + lengths], 1e-300)
    share = sums[places[which] + start] * scaled * back[places[which] + end] / total[which] * weights[which]
    for k in range(out.shape[1]):
        out[:, k] = np.bincount(piece, share[:, k], len(out))
    return out


def _letters(texts: pa.Array) -> pa.Array:
    """Lower-case words of letters; may hold empty words."""
    return pc.split_pattern_regex(pc.utf8_lower(texts), r"\P{L}+")


def learn(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
    model_path: str | None = None,
) -> Model:
    """Piece probabilities of every label of ``docs``.

    About ``sample`` documents of each label are read whole, chosen by a hash of their id: this
    bounds the words learnt from, whatever the size of the corpus. Rows without label or text
    teach nothing. What reaches the driver is one number per piece and language.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col)).count().collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return Model((), np.zeros((0, 0)))
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang_col) == name, F.lit(min(1.0, sample / n))).otherwise(share)
    dice = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = labelled.where(dice < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            langs = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, SLICE):
                cut = _letters(batch.column(1).slice(at, SLICE)).to_pylist()
                for lang, words in zip(langs[at:], cut, strict=False):
                    counts.update((lang, w) for w in words if w)
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(counts.values(), pa.int64())],
                names=["lang", "word", "n"],
            )

    spark = ready(docs.sparkSession)
    words = chosen.mapInArrow(tally, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = saved(words, "words")
    _, n, _ = matcher(model_path)
    column = {name: k for k, name in enumerate(languages)}
    chances = np.full((n + 1, len(languages)), 1.0 / n)
    chances[n] = STRANGE
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chances)

        def uses(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                own, index = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
                counts = np.zeros((len(own), len(languages)))
                for k, lang, m in zip(index, batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    counts[k, column[lang]] += m
                some = expected(list(own), counts, shared.value, model_path)
                total = some if total is None else total + some
            if total is not None:
                rows, columns = np.nonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), pa.array(total[rows, columns])],
                    names=["piece", "lang", "n"],
                )

        told = words.mapInArrow(uses, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full_like(chances, SMOOTH)
        counts[told["piece"].to_numpy(), told["lang"].to_numpy()] += told["n"].to_numpy()
        chances = counts / counts[:n].sum(axis=0)
        chances[n] = STRANGE
        shared.unpersist()
    return Model(languages, chances)


class Scorer:
    """Scores whole texts under a model."""

    def __init__(self, model: Model, path: str | None = None):
        self.model, self.path = model, path
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, texts: pa.Array) -> Iterator[tuple[list[str], np.ndarray]]:
        """Languages and their probability among the known ones, run by run."""
        names = np.array([*self.model.languages, UNKNOWN], object)
        for _, some in runs(texts):
            words, index, bounds = distinct(_letters(some))
            full = np.fromiter(map(bool, words), bool, len(words))
            letters = summed(full[index].astype(np.int64), bounds) > 0
            if not self.model.languages:
                yield [UNKNOWN] * len(some), np.zeros(len(some))
                continue
            logs = self._words(words, np.bincount(index, minlength=len(words)))
            logs[~full] = 0.0
            totals = np.stack([summed(logs[:, k][index], bounds) for k in range(logs.shape[1])], axis=1)
            best = totals.argmax(axis=1)
            score = 1.0 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
            best[~letters] = len(names) - 1
            yield names[best].tolist(), np.where(letters, score, 0.0)

    def _words(self, words: list[str], seen: np.ndarray) -> np.ndarray:
        found = [*map(self.kept.get, words)]
        new = [i for i, known in enumerate(found) if known is None]
        logs = log_chances([words[i] for i in new], self.model.chances, self.path)
        out = np.zeros((len(words), len(self.model.languages)))
        out[new] = logs
        old = [i for i, known in enumerate(found) if known is not None]
        if old:
            out[old] = np.stack([found[i] for i in old])
        for i in new if len(self.kept) < KEPT else ():
            if seen[i] >= OFTEN and len(self.kept) < KEPT:
                self.kept[words[i]] = out[i].copy()
        return out


def identified(docs: DataFrame, model: Model, text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """All rows and columns, with ``lang_pred`` and ``score`` (0 to 1) after them.

    ``und`` with score 0 where the text is null or has no letter, or no language is known. Of
    equally likely languages the first by name. No rows give no rows.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value, model_path)
        for batch in batches:
            at = 0
            for langs, scores in score(batch.column(batch.schema.get_field_index(text_col))):
                some = batch.slice(at, len(langs))
                at += len(langs)
                columns = [some.column(i) for i, n in enumerate(some.schema.names) if n not in ("lang_pred", "score")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores)], names=names)

    kept = docs.drop("lang_pred", "score")
    schema = kept.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    names = [f.name for f in schema]
    return kept.mapInArrow(run, schema)


def teaching(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows whose id's check sum leaves another rest than 2 by 4; rows without id teach nothing."""
    return docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2)


def accepted(docs: DataFrame, model: Model, lowest: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows whose text is in a known language: not ``und``, and scored ``lowest`` at least."""
    kept = docs.columns
    marked = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    found = identified(marked, model)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= lowest)).select(*[F.col("row")[c].alias(c) for c in kept])


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(teaching(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
