"""The fixed public piece vocabulary, and the distinct words of a run of texts."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "piece_bpe_32k.model"
#: What stands for a space in pieces.
SPACE = "▁"
#: Bytes of text that are cut at a time.
AT_ONCE = 8 << 20


@functools.lru_cache(maxsize=4)
def vocabulary(path: str | None = None) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """Pieces in the order of their ids, and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    ids = range(model.get_piece_size())
    return tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids)


def runs(texts: pa.Array, at_once: int = AT_ONCE) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows with at most ``at_once`` bytes, one row at least; nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + at_once, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def distinct(cut: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of lists of words: the distinct words, the place of each word among them, the lists' bounds."""
    bounds = cut.offsets.to_numpy().astype(np.int64)
    coded = cut.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), bounds - bounds[0]


def summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums between bounds; empty stretches sum to zero."""
    totals = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return totals[bounds[1:]] - totals[bounds[:-1]]
