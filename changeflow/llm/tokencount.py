"""Token counts under a unigram model, without building the tokens.

The vocabulary is the pieces and scores of a public model, read as a unigram model that cuts
before each space. An Aho-Corasick automaton enumerates the pieces that end at each character; the
forward pass keeps the best score and its number of pieces. Ties go the way of the tokenizers
library: a candidate must be better than what is there, and candidates come in the order of their
starts, so of equal ones the longest piece wins; a character that is no piece costs the lowest
score minus ten and counts its bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm.common import ready, table
from changeflow.llm.pieces import SPACE, distinct, runs, summed, vocabulary

#: Words whose count a worker keeps, and how often a run of texts must hold them.
KEPT, OFTEN = 200_000, 2
UNKNOWN = 10.0


class Counter:
    """Best score and piece count of a word."""

    def __init__(self, path: str | None = None):
        pieces, scores = vocabulary(path)
        self.found = ahocorasick.Automaton()
        for piece, score in zip(pieces, scores, strict=True):
            if piece:
                self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        self.single = frozenset(p for p in pieces if len(p) == 1)
        self.unknown = min(scores) - UNKNOWN
        self.kept: dict[str, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        """Pieces and score of one word, its leading space mark included in ``word``."""
        n = len(word)
        best, pieces = [None] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(word):
            for end, (length, score) in self.found.iter(word):
                start = end + 1 - length
                total = best[start] + score
                if best[end + 1] is None or total > best[end + 1]:
                    best[end + 1], pieces[end + 1] = total, pieces[start] + 1
            return pieces[n], best[n]
        matches: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.found.iter(word):
            matches[end].append(match)
        for end in range(n):
            for length, score in matches[end]:
                start = end + 1 - length
                total = best[start] + score
                if best[end + 1] is None or total > best[end + 1]:
                    best[end + 1], pieces[end + 1] = total, pieces[start] + 1
            if word[end] not in self.single:
                total = best[end] + self.unknown
                if best[end + 1] is None or total > best[end + 1]:
                    best[end + 1] = total
                    pieces[end + 1] = pieces[end] + len(word[end].encode("utf-8", "surrogatepass"))
        return pieces[n], best[n]

    def __call__(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Piece counts and scores of whole texts, run by run."""
        for _, some in runs(texts):
            empty = pc.equal(some, "").to_numpy(zero_copy_only=False)
            some = pc.replace_substring(some, SPACE, " ")
            some = pc.replace_substring_regex(some, "^ ", "")
            words, index, bounds = distinct(pc.split_pattern(some, " "))
            seen = np.bincount(index, minlength=len(words))
            found = [*map(self.kept.get, words)]
            for i, known in enumerate(found):
                if known is None:
                    found[i] = known = self.count(SPACE + words[i])
                    if seen[i] >= OFTEN and len(self.kept) < KEPT:
                        self.kept[words[i]] = known
            counts = np.fromiter((f[0] for f in found), np.int64, len(found))[index]
            scores = np.fromiter((f[1] for f in found), np.float64, len(found))[index]
            yield np.where(empty, 0, summed(counts, bounds)), np.where(empty, 0.0, _exactly(scores, bounds))


def _exactly(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between bounds, each started anew; every stretch has a value."""
    return np.add.reduceat(values, bounds[:-1]) if len(values) else np.zeros(len(bounds) - 1)


@functools.lru_cache(maxsize=1)
def counter(path: str | None = None) -> Counter:
    """One counter for each worker process."""
    return Counter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, score)`` per row: pieces of the best segmentation, and its score.

    Null and empty texts have none (score 0). Repeated rows and null ids stay rows of their own,
    other columns are left out, no rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path)
        for batch in batches:
            at = 0
            for counts, scores in count(batch.column(1)):
                ids = batch.column(0).slice(at, len(counts))
                at += len(counts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(scores)], schema=schema)

    ready(docs.sparkSession)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_tokens long, score double")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
