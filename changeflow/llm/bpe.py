"""Byte-level BPE ids of whole texts, by the tokenizers library, each distinct piece encoded once.

A token of this vocabulary never reaches across a single space between two characters that are no
white space: the space opens the next token. So texts are cut there, equal pieces of a batch are
found by Arrow's dictionary encoding, the library encodes each distinct piece, and Arrow puts the
ids back in place. The results equal one call over each whole text; a text that has other white
space beside a space, or one of the vocabulary's special tokens written out, takes that call.
"""

from __future__ import annotations

import functools
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text that are cut and put together at a time.
AT_ONCE = 12 << 20
#: Frequent pieces whose ids a worker keeps: how many, and how often a slice must hold them; and
#: how many words (what the cutter leaves) it keeps.
KEPT, OFTEN, WORDS = 120_000, 3, 150_000
#: The vocabulary's own cutting pattern, with its letter and number classes written out for the
#: characters up to U+00FF. Pieces with other characters go to the library's own cutter.
LATIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zªµºÀ-ÖØ-öø-ÿ]+| ?[0-9²³¹¼½¾]+"
    r"| ?[^\sA-Za-zªµºÀ-ÖØ-öø-ÿ0-9²³¹¼½¾]+|\s+(?!\S)|\s+"
)
OTHER = re.compile("[^\x09-\x0d\x20-\x7e\xa1-\xff]")
#: Characters that no version of Unicode takes for white space.
SOLID = r"[\p{L}\p{N}!-~¡-ÿ]"


class Encoder:
    """Encodes whole texts to unsigned 32-bit ids."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        assert sys.byteorder == "little"
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        self.added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.kept: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each run of rows: its first row, the ids one after another, and the rows' bounds.

        Null and empty texts have no ids.
        """
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + AT_ONCE, "right")))
            yield at, *self._run(texts.slice(at, to - at))
            at = to

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of one text."""
        return self._run(pa.array([text], pa.string()))[0]

    def _run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.split_pattern(texts, " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        starts, lasts = bounds[:-1], bounds[1:] - 1
        coded = cut.flatten().dictionary_encode()
        index, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary

        # Texts that can't be cut at each space.
        opens = _matches(pieces, f"^{SOLID}")[index]
        closes = _matches(pieces, f"{SOLID}$")[index]
        opens[starts] = closes[lasts] = True
        uncut = np.add.reduceat(~(opens & closes), starts, dtype=np.int64) > 0
        for token in self.added:
            uncut |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        keep = np.ones(len(index), bool)
        for row in np.flatnonzero(uncut):
            keep[starts[row] : bounds[row + 1]] = False

        # Ids of the distinct pieces, of each text's first piece (no space before it), of uncut texts.
        seen = np.bincount(index[keep], minlength=len(pieces))
        follow = np.flatnonzero(seen)
        values, lengths = self._pieces(pieces.take(pa.array(follow)).to_pylist(), seen[follow])
        place = np.zeros(len(pieces), np.int64)
        place[follow] = np.arange(len(follow))
        index = place[index]
        first = pieces.take(coded.indices.take(pa.array(starts))).dictionary_encode()
        front, front_lengths = _joined([*map(self._piece, first.dictionary.to_pylist())])
        index[starts] = len(follow) + first.indices.to_numpy()
        whole = [self._whole(texts[r].as_py()) for r in np.flatnonzero(uncut).tolist()]
        index[starts[uncut]] = len(follow) + len(front_lengths) + np.arange(len(whole))
        keep[starts] = True
        at = np.concatenate([[0], np.cumsum(keep)])
        index, bounds = index[keep], at[bounds]

        lengths = np.concatenate([lengths, front_lengths, np.array([len(w) for w in whole], np.int64)])
        ids = np.concatenate([values, front, *whole])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(ids))
        out = lists.take(pa.array(index)).flatten().to_numpy()
        return out, np.concatenate([[0], np.cumsum(lengths[index])])[bounds]

    def _pieces(self, pieces: list[str], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that follow a space, and how many each has."""
        found = [*map(self.kept.get, pieces)]
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = ids = self._piece(" " + pieces[i])
                if seen[i] >= OFTEN and len(self.kept) < KEPT:
                    self.kept[pieces[i]] = ids
        return _joined(found)

    def _piece(self, piece: str) -> bytes:
        if OTHER.search(piece):
            return self._whole(piece).tobytes()
        words, out = self.words, []
        for word in LATIN.findall(piece):
            ids = words.get(word)
            if ids is None:
                shown = word.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.merge(shown)]).tobytes()
                if len(words) < WORDS:
                    words[word] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable bytes stay."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4


def _matches(pieces: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(pieces, pattern).to_numpy(zero_copy_only=False)


@functools.lru_cache(maxsize=1)
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)
