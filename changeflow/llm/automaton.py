"""Weighted acyclic automata over words: minimal count transducers, their union and composition.

A *trie* is a list of levels; a level is three arrays ``(parent, label, weight)`` with one entry for
each path of that length, in the order of the paths: the entry's parent on the level before, its
last label, its weight (0 where the path only leads on). Parents and labels are 32-bit numbers, a
task's paths of one length are fewer. A :class:`Transducer` is the same language with equal states
merged, a label table, and a byte form.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

Level = tuple[np.ndarray, np.ndarray, np.ndarray]
Trie = list[Level]


def _keys(parent: np.ndarray, label: np.ndarray, labels: int) -> np.ndarray:
    """Parent and label as one number, in the order of the paths."""
    keys = parent.astype(np.int64)
    keys *= labels
    keys += label
    return keys


def _level(keys: np.ndarray, weights: np.ndarray, labels: int) -> Level:
    """The level with these keys."""
    return (keys // labels).astype(np.int32), (keys % labels).astype(np.int32), weights


def _grouped(keys: np.ndarray, weights: np.ndarray, op: np.ufunc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their weights put together by ``op``, and each entry's place among them."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    opens = np.ones(len(held), bool)
    opens[1:] = held[1:] != held[:-1]
    firsts = np.flatnonzero(opens)
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(opens, dtype=np.int32) - 1
    summed = op.reduceat(weights[order], firsts) if len(firsts) else weights[:0]
    return held[firsts], summed, place


def from_paths(
    columns: list[np.ndarray], depth: np.ndarray, weight: np.ndarray, labels: int, op: np.ufunc = np.add, every: bool = False
) -> Trie:
    """The trie of paths: path ``i`` reads ``columns[0][i]``, ``columns[1][i]`` … for ``depth[i]`` labels.

    A path's weight counts at its end, or with ``every`` at each of its prefixes, too. Paths are
    sorted level by level, so each one shares with its forerunner all they have in common.
    """
    alive, node, trie = np.arange(len(depth), dtype=np.int32), np.zeros(len(depth), np.int32), []
    for k, column in enumerate(columns):
        on = depth[alive] > k
        alive, node = alive[on], node[on]
        if not len(alive):
            break
        counts = weight[alive] if every else np.where(depth[alive] == k + 1, weight[alive], 0)
        keys, summed, node = _grouped(_keys(node, column[alive], labels), counts, op)
        trie.append(_level(keys, summed, labels))
    return trie


def merged(tries: list[Trie], labels: int, op: np.ufunc = np.add) -> Trie:
    """The union of tries over one label table; weights of equal paths are put together by ``op``."""
    maps, out = [np.zeros(1, np.int32) for _ in tries], []
    for k in range(max(map(len, tries), default=0)):
        held = [(i, t[k]) for i, t in enumerate(tries) if len(t) > k]
        keys = np.concatenate([_keys(maps[i][p], x, labels) for i, (p, x, _) in held])
        keys, summed, place = _grouped(keys, np.concatenate([w for _, (_, _, w) in held]), op)
        at = 0
        for i, (p, _, _) in held:
            maps[i] = place[at : at + len(p)]
            at += len(p)
        out.append(_level(keys, summed, labels))
    return out


def pruned(trie: Trie, least: int) -> Trie:
    """Paths that weigh ``least`` or more, and what leads to them."""
    out: Trie = []
    kept_above = None
    for parent, label, weight in reversed(trie):
        keep = weight >= least
        if kept_above is not None:
            keep[kept_above] = True
        out.append((parent, label, np.where(weight >= least, weight, 0), keep))
        kept_above = parent[keep]
    return _dense(out[::-1])


def _dense(levels: list[tuple]) -> Trie:
    """Levels ``(parent, label, weight, keep)`` without what isn't kept."""
    out, place = [], None
    for parent, label, weight, keep in levels:
        if not keep.any():
            break
        up = parent[keep] if place is None else place[parent[keep]]
        out.append((up, label[keep], weight[keep]))
        place = np.cumsum(keep, dtype=np.int32) - 1
    return out


def walked(trie: Trie, transducer: Trie, labels: int) -> Trie:
    """Composition: ``trie`` with the weight each of its paths has in ``transducer`` (0: none)."""
    match, out = np.zeros(1, np.int64), []
    for k, (parent, label, _) in enumerate(trie):
        up = match[parent]
        if k < len(transducer):
            keys = _keys(*transducer[k][:2], labels)
            at = np.minimum(np.searchsorted(keys, up * labels + label), len(keys) - 1)
            hit = (up >= 0) & (keys[at] == up * labels + label)
            match, weight = np.where(hit, at, -1), np.where(hit, transducer[k][2][at], 0)
        else:
            match, weight = np.full(len(parent), -1), np.zeros(len(parent), np.int64)
        out.append((parent, label, weight))
    return out


def weights_of(trie: Trie, columns: list[np.ndarray], labels: int) -> np.ndarray:
    """The weights of paths of equal length, 0 for those that aren't there."""
    node = np.zeros(len(columns[0]), np.int64)
    for k, column in enumerate(columns):
        if k >= len(trie):
            return np.zeros(len(node), np.int64)
        keys = _keys(*trie[k][:2], labels)
        want = node * labels + column
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        node = np.where((node >= 0) & (keys[at] == want), at, -1)
    return np.where(node >= 0, trie[len(columns) - 1][2][node], 0)


def spelled(trie: Trie, depth: int, paths: np.ndarray | None = None) -> list[np.ndarray]:
    """The labels of all paths of one length, or of those numbered ``paths``, a column for each place."""
    node, columns = np.arange(len(trie[depth - 1][0])) if paths is None else paths, []
    for parent, label, _ in reversed(trie[:depth]):
        columns.append(label[node])
        node = parent[node]
    return columns[::-1]


def cuts(trie: Trie, symbols: list[str], bounds: list[tuple[str, ...]]) -> list[list[int]]:
    """For each level, how many of its paths stand before each of ``bounds`` (paths of full length)."""
    children = [np.searchsorted(trie[k + 1][0], np.arange(len(trie[k][0]) + 1, dtype=np.int32)) for k in range(len(trie) - 1)]
    out: list[list[int]] = [[] for _ in trie]
    for bound in bounds:
        low, high, exact = 0, len(trie[0][0]) if trie else 0, True
        for k in range(len(trie)):
            if exact:
                rank = bisect_left(symbols, bound[k])
                at = low + int(np.searchsorted(trie[k][1][low:high], rank))
                exact = at < high and rank < len(symbols) and symbols[rank] == bound[k] and trie[k][1][at] == rank
            else:
                at = low
            out[k].append(at + (exact and k + 1 < len(bound)))
            if k + 1 < len(trie):
                low = int(children[k][at])
                high = int(children[k][at + 1]) if exact else low
    return out


def sliced(trie: Trie, low: list[int], high: list[int]) -> Trie:
    """Paths ``low`` to ``high`` of every level; what only leads to them weighs nothing."""
    froms = list(low)
    for k in reversed(range(len(trie) - 1)):
        if froms[k + 1] < high[k + 1]:
            froms[k] = min(froms[k], int(trie[k + 1][0][froms[k + 1]]))
    out = []
    for k, (parent, label, weight) in enumerate(trie):
        a, b = froms[k], high[k]
        if a >= b:
            break
        counts = weight[a:b].copy()
        counts[: max(0, low[k] - a)] = 0
        out.append((parent[a:b] - (froms[k - 1] if k else 0), label[a:b], counts))
    return out


_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _registered(level: Level, target: np.ndarray, nodes: int) -> tuple[tuple, np.ndarray]:
    """States of one level with equal ones merged: their arcs, and the state of each of ``nodes``.

    State 0 has no arcs. A state is known by its arcs' labels, weights and targets; a hash proposes
    equal ones, and the arcs themselves decide.
    """
    parent, label, weight = level
    starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])).astype(np.int32)
    lengths = np.diff(np.append(starts, np.int32(len(parent))))
    place = np.arange(len(parent), dtype=np.int32) - np.repeat(starts, lengths)
    hashed = _mixed(target.astype(np.uint64) + _MIX[0])
    hashed ^= weight.astype(np.uint64)
    hashed = _mixed(hashed)
    hashed ^= label.astype(np.uint64) * _MIX[0]
    hashed = _mixed(hashed)
    hashed += place.astype(np.uint64) * _MIX[2]
    hashed = _mixed(hashed)
    signs = np.add.reduceat(hashed, starts) + lengths.astype(np.uint64)
    del hashed
    _, first, sort = np.unique(signs, return_index=True, return_inverse=True)
    del signs
    alike = first[sort]
    same = lengths == lengths[alike]
    at = np.minimum(np.repeat(starts[alike], lengths) + place, len(parent) - 1)
    for x in label, weight, target:
        same &= np.logical_and.reduceat(x[at] == x, starts)
    del at, place
    same[first] = True
    keep = ~same
    keep[first] = True
    number = np.cumsum(keep)
    state = np.where(same, number[alike], number)
    arcs = np.repeat(keep, lengths)
    bounds = np.concatenate([[0, 0], np.cumsum(lengths[keep], dtype=np.int64)])
    of_node = np.zeros(nodes, np.int64)
    of_node[parent[starts]] = state
    return (bounds, label[arcs], weight[arcs], target[arcs]), of_node


class Transducer:
    """A minimal acyclic automaton with weights, over a sorted label table."""

    def __init__(self, symbols: pa.Array, states: list[tuple]):
        self.symbols, self.states = symbols, states

    @classmethod
    def of(cls, trie: Trie, symbols: pa.Array) -> Transducer:
        """From a trie whose labels are places in ``symbols``; only labels in use are kept."""
        flags = np.zeros(len(symbols), bool)
        for _, x, _ in trie:
            flags[x] = True
        used, place = np.flatnonzero(flags), np.cumsum(flags, dtype=np.int32) - 1
        states, target = [], None
        for k in reversed(range(len(trie))):
            parent, label, weight = trie[k]
            if target is None:
                target = np.zeros(len(parent), np.int64)
            nodes = len(trie[k - 1][0]) if k else 1
            arcs, target = _registered((parent, place[label], weight), target, nodes)
            states.append(arcs)
        return cls(symbols.take(pa.array(used)), states[::-1])

    def trie(self) -> Trie:
        """All paths again."""
        out, node = [], np.ones(1, np.int64)
        for bounds, label, weight, target in self.states:
            lengths = bounds[node + 1] - bounds[node]
            ends = np.cumsum(lengths)
            arc = np.repeat(bounds[node] - ends + lengths, lengths) + np.arange(ends[-1])
            above = np.repeat(np.arange(len(node), dtype=np.int32), lengths)
            out.append((above, label[arc].astype(np.int32), weight[arc].astype(np.int64)))
            node = target[arc]
        return out

    def arcs(self) -> int:
        return sum(len(label) for _, label, _, _ in self.states)

    def to_bytes(self) -> bytes:
        small = [tuple(a.astype(_width(a)) for a in arcs) for arcs in self.states]
        texts, letters, ends = self.symbols, b"", np.zeros(1, np.int64)
        if len(texts):
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            letters = texts.buffers()[2][ends[0] : ends[-1]].to_pybytes()
        sizes = np.diff(ends)
        return zstandard.ZstdCompressor(1).compress(pickle.dumps((sizes.astype(_width(sizes)), letters, small), protocol=5))

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        sizes, letters, small = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        symbols = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(letters))
        return cls(symbols, [(b.astype(np.int64), x, w, t.astype(np.int64)) for b, x, w, t in small])


def _width(values: np.ndarray) -> type:
    top = int(values.max()) if len(values) else 0
    return np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64


def shared_labels(automata: list[Transducer]) -> tuple[pa.Array, list[Trie]]:
    """One sorted label table for all, and their tries over it."""
    tables = [a.symbols for a in automata] or [pa.array([], pa.large_string())]
    coded = pa.concat_arrays(tables).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order))
    place, tries, at = rank[coded.indices.to_numpy()], [], 0
    for a in automata:
        own = place[at : at + len(a.symbols)]
        tries.append([(p, own[x], w) for p, x, w in a.trie()])
        at += len(own)
    return coded.dictionary.take(order), tries
