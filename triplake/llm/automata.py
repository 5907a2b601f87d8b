"""Acyclic automata that carry counts: built from sorted paths, summed by prefix range, composed with queries.

A path is a sequence of labels (byte strings) from the start state, with the sum of what was counted for it. Arcs of a state
lie together, sorted by label. States at the end of the longest paths that have one and the same single arc are shared, so
an automaton of many n-grams that were seen once stays small.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import zstandard


def _steps(numbers: np.ndarray) -> np.ndarray:
    return np.diff(numbers, prepend=0).astype(np.uint32)


class Counts:
    """Sorted distinct paths over an alphabet, as arrays: labels (n, depth) with -1 beyond a path's end, and weights."""

    def __init__(self, alphabet: list[bytes], labels: np.ndarray, weights: np.ndarray):
        self.alphabet, self.labels, self.weights = alphabet, labels, weights

    @staticmethod
    def of(alphabet: list[bytes], labels: np.ndarray, weights: np.ndarray) -> Counts:
        """From unsorted paths over a sorted alphabet; weights of equal paths are summed."""
        if not len(labels):
            return Counts(alphabet, labels, weights)
        bits = len(alphabet).bit_length()
        each = 63 // bits if bits else labels.shape[1]  # labels that make one number, so that there are fewer sorts
        keys = []
        for a in range(0, labels.shape[1], each):
            key = np.zeros(len(labels), np.int64)
            for d in range(a, min(a + each, labels.shape[1])):
                key = key << bits | (labels[:, d] + 1)
            keys.append(key)
        order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
        labels, weights = labels[order], weights[order]
        first = np.zeros(len(labels), bool)
        first[0] = True
        for key in keys:
            first[1:] |= np.diff(key[order]) != 0
        first = np.flatnonzero(first)
        return Counts(alphabet, labels[first], np.add.reduceat(weights, first))

    @staticmethod
    def union(parts: list[Counts]) -> Counts:
        """Weights of equal paths are summed."""
        alphabet = sorted(set().union(*(p.alphabet for p in parts)))
        at = {w: i for i, w in enumerate(alphabet)}
        moved = []
        for p in parts:
            to = np.array([*map(at.__getitem__, p.alphabet), -1], np.int32)  # -1, the end, stays -1
            moved.append(to[p.labels])
        return Counts.of(alphabet, np.concatenate(moved), np.concatenate([p.weights for p in parts]))

    def where(self, kept: np.ndarray) -> Counts:
        """The paths marked, over the letters they use."""
        return self._own(self.labels[kept], self.weights[kept])

    def between(self, a: int, b: int) -> Counts:
        """The paths from the a-th to before the b-th, over the letters they use; its work is in their number, not in that of all paths."""
        return self._own(self.labels[a:b], self.weights[a:b])

    def _own(self, labels: np.ndarray, weights: np.ndarray) -> Counts:
        code, used = pd.factorize(labels.ravel(), sort=False)
        order = np.argsort(used)
        start = int(len(used) > 0 and used[order[0]] < 0)  # the end, -1, stays -1
        to = np.empty(len(used), np.int32)
        to[order] = np.arange(len(used)) - start
        return Counts([self.alphabet[i] for i in used[order[start:]].tolist()], to[code].reshape(labels.shape), weights)

    def lengths(self) -> np.ndarray:
        return (self.labels >= 0).sum(axis=1)

    def paths(self) -> list[tuple[bytes, ...]]:
        return [tuple(self.alphabet[i] for i in row if i >= 0) for row in self.labels.tolist()]

    def compose(self, queries: list[tuple[bytes, ...]]) -> list[int]:
        """The weight of each sorted query path, 0 if there is none: both automata are walked side by side."""
        at = {w: i for i, w in enumerate(self.alphabet)}
        own = self.labels
        out = []
        low, high, held = [0] * (own.shape[1] + 1), [len(own)] * (own.shape[1] + 1), ()
        for path in queries:
            same = 0
            while same < min(len(path), len(held)) and path[same] == held[same]:
                same += 1  # the states on a shared prefix are still at hand
            for d in range(same, len(path)):
                label = at.get(path[d], -1)
                a, b = low[d], high[d]
                column = own[a:b, d]
                low[d + 1], high[d + 1] = (a + int(np.searchsorted(column, label, side)) for side in ("left", "right")) if label >= 0 else (a, a)
            held = path
            a, b = low[len(path)], high[len(path)]
            found = a < b and (len(path) == own.shape[1] or own[a, len(path)] < 0)  # the path itself sorts before its extensions
            out.append(int(self.weights[a]) if found else 0)
        return out

    def pack(self) -> bytes:
        """The automaton, compressed: for each depth its arcs' labels, weights and numbers of arcs below; the last depth by shared states."""
        depth, labels, lengths = self.labels.shape[1], self.labels, self.lengths()
        blocks = [b"\xff".join([b"", *self.alphabet])]  # a byte that UTF-8 does not have
        same, number = np.ones(max(0, len(labels) - 1), bool), np.zeros(len(labels), np.int64)  # paths are sorted, so those on one arc are neighbours
        for d in range(depth):
            same = same & (labels[1:, d] == labels[:-1, d])
            new = labels[:, d] >= 0  # the first path on an arc of this depth
            new[1:] &= ~same
            arcs = np.flatnonzero(new)
            ends = lengths[arcs] == d + 1  # the path ends with this arc: its weight is its own
            above = number[arcs]  # numbers of the arcs of depth d - 1 that lead here
            first = np.ones(len(arcs), bool)
            first[1:] = above[1:] != above[:-1]
            label, weight, starts = labels[arcs, d].astype(np.uint32), np.where(ends, self.weights[arcs], 0).astype(np.uint64), np.flatnonzero(first)
            if d == depth - 1 and len(arcs):
                fan = np.diff(np.append(starts, len(arcs)))
                single = starts[fan == 1]
                kind, weights = pd.factorize(weight[single])
                which, shared = pd.factorize(label[single].astype(np.int64) * len(weights) + kind)
                many = np.ones(len(arcs), bool)
                many[single] = False
                state = np.zeros(len(starts), np.uint32)
                state[fan == 1] = which
                state[fan > 1] = len(shared) + np.arange((fan > 1).sum())
                one, one_weight = (shared // max(1, len(weights))).astype(np.uint32), weights[shared % max(1, len(weights))]
                # last, to which arc above each state belongs, as steps from one to the next
                blocks += [a.tobytes() for a in (state, one, one_weight, label[many], weight[many], fan[fan > 1].astype(np.uint32), _steps(above[starts]))]
            elif d == depth - 1:
                blocks += [b""] * 7
            else:
                blocks += [label.tobytes(), weight.tobytes(), (_steps(above) if d else np.zeros(0, np.uint32)).tobytes()]
            number = np.cumsum(new) - 1
        head = struct.pack(f"<II{len(blocks)}Q", depth, len(blocks), *map(len, blocks))
        return zstandard.compress(head + b"".join(blocks), 1)

    @staticmethod
    def unpack(packed: bytes, ordered: bool = True) -> Counts:
        """What pack() was given; unordered, the paths may only go into a union."""
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=1 << 31)
        depth, n = struct.unpack_from("<II", raw)
        sizes = struct.unpack_from(f"<{n}Q", raw, 8)
        at, blocks = 8 + 8 * n, []
        for s in sizes:
            blocks.append(raw[at : at + s])
            at += s
        alphabet = blocks[0].split(b"\xff")[1:]
        u4, u8 = (lambda b: np.frombuffer(b, np.uint32)), (lambda b: np.frombuffer(b, np.uint64))
        above, labels, weights = np.full((1, 0), -1, np.int32), [], []
        for d in range(depth):
            own = blocks[1 + 3 * d : 4 + 3 * d] if d < depth - 1 else blocks[1 + 3 * d :]
            if d < depth - 1:
                label, weight = u4(own[0]), u8(own[1])
                parent = np.cumsum(u4(own[2]).astype(np.int64)) if d else np.zeros(len(label), np.int64)
            else:
                state, one, one_weight, many, many_weight, fan = u4(own[0]), u4(own[1]), u8(own[2]), u4(own[3]), u8(own[4]), u4(own[5])
                parent = np.cumsum(u4(own[6]).astype(np.int64))
                all_labels, all_weights = np.concatenate([one, many]), np.concatenate([one_weight, many_weight])
                first = np.concatenate([np.arange(len(one)), len(one) + np.cumsum(fan) - fan])
                count = np.concatenate([np.ones(len(one), np.int64), fan.astype(np.int64)])
                times = count[state]
                inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                arcs = np.repeat(first[state], times) + inside
                label, weight, parent = all_labels[arcs.astype(np.int64)], all_weights[arcs.astype(np.int64)], np.repeat(parent, times)
            paths = np.concatenate([above[parent], label.astype(np.int32)[:, None]], axis=1)
            labels.append(np.pad(paths, ((0, 0), (0, depth - d - 1)), constant_values=-1))
            weights.append(weight.astype(np.int64))
            above = paths
        every, weight = np.concatenate(labels), np.concatenate(weights)
        own = weight > 0  # arcs that only lead on have no weight
        return Counts.of(alphabet, every[own], weight[own]) if ordered else Counts(alphabet, every[own], weight[own])
