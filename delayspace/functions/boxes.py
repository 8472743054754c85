"""A tree of boxes over states: where a state lies, and which boxes a ball around it reaches.

Nodes are numbered as in a heap: node i has children 2 i + 1 and 2 i + 2, and all leaves are on one level. Rows are told apart by
their place in the series where their states are equal, so that no leaf has to hold all copies of a state.

Bounds are exact in floating point: differences, squares, sums in one order and roots are monotone when rounded, so the bound of a box is never above the
distance, as :func:`kernels.distances` works it out, of a row within it.
"""

from __future__ import annotations

import numpy as np

from .kernels import nearest

#: Rows of a leaf, about.
LEAF = 256
#: Pairs of rows and boxes that are looked at together.
FRONTIER = 4_000_000


class Boxes:
    """Splits of a tree (``axis`` and ``cut`` by node; the last axis is the row), and the boxes of its nodes once they are fitted."""

    def __init__(self, axis: np.ndarray, cut: np.ndarray):
        self.axis, self.cut = axis, cut
        self.leaves = len(axis) + 1
        self.low = self.high = self.count = None

    @classmethod
    def grow(cls, states: np.ndarray, rows: np.ndarray, depth: int) -> Boxes:
        """Halve ``states`` ``depth`` times at the median along their widest axis; rows are an axis where states are all alike."""
        n = (1 << depth) - 1
        axis, cut = np.zeros(n, np.int64), np.full(n, np.inf)
        held = {0: np.arange(len(states))}
        for node in range(n):
            own = held.pop(node)
            if len(own) > 1:
                at = states[own]
                spread = at.max(axis=0) - at.min(axis=0)
                j = int(np.argmax(spread))
                values = at[:, j] if spread[j] > 0 else rows[own].astype(float)
                axis[node] = j if spread[j] > 0 else states.shape[1]
                middle = np.partition(values, (len(own) - 1) // 2)[(len(own) - 1) // 2]
                if middle == values.max():  # over half are alike: those below go to the left
                    below = values[values < middle]
                    middle = below.max() if len(below) else middle
                cut[node] = middle
                left = values <= middle
            else:
                left = np.ones(len(own), bool)
            if 2 * node + 1 < n:
                held[2 * node + 1], held[2 * node + 2] = own[left], own[~left]
        return cls(axis, cut)

    def leaf(self, states: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The leaf of each state."""
        at = np.zeros(len(states), np.int64)
        every = np.column_stack((states, rows.astype(float)))
        while len(at) and len(self.axis) and at[0] < len(self.axis):
            at = 2 * at + 1 + (every[np.arange(len(at)), self.axis[at]] > self.cut[at])
        return at - len(self.axis)

    def fit(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> Boxes:
        """Take the leaves' boxes, rows as last axis, and their numbers of rows; nodes above get those of their leaves together."""
        inner = len(self.axis)
        self.low = np.concatenate((np.full((inner, low.shape[1]), np.inf), low))
        self.high = np.concatenate((np.full((inner, low.shape[1]), -np.inf), high))
        self.count = np.concatenate((np.zeros(inner, np.int64), count))
        for node in range(inner - 1, -1, -1):
            a, b = 2 * node + 1, 2 * node + 2
            self.low[node], self.high[node] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])
            self.count[node] = self.count[a] + self.count[b]
        return self

    def fit_rows(self, leaf: np.ndarray, states: np.ndarray, rows: np.ndarray) -> Boxes:
        every = np.column_stack((states, rows.astype(float)))
        low, high = np.full((self.leaves, every.shape[1]), np.inf), np.full((self.leaves, every.shape[1]), -np.inf)
        np.minimum.at(low, leaf, every)
        np.maximum.at(high, leaf, every)
        return self.fit(low, high, np.bincount(leaf, minlength=self.leaves))

    def least(self, states: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Least distance of each state from its node's box."""
        total = np.zeros(len(states))
        for j in range(states.shape[1]):
            diff = np.maximum(0.0, np.maximum(self.low[node, j] - states[:, j], states[:, j] - self.high[node, j]))
            total += diff * diff
        return np.sqrt(total)

    def reach(self, states: np.ndarray, rows: np.ndarray, far: np.ndarray, gap: np.ndarray, radius: int):
        """Yields (places of states, leaves) whose rows may come before (distance ``far``, row difference ``gap``), some states at a time."""
        step = max(1, FRONTIER // (4 * self.leaves))
        for first in range(0, len(states), step):
            who, node = np.arange(first, min(len(states), first + step)), np.zeros(min(step, len(states) - first), np.int64)
            for level in range(int(self.leaves).bit_length()):
                low, high = self.low[node, -1], self.high[node, -1]
                p = rows[who]
                apart = np.maximum(0, np.maximum(low - p, p - high))
                least = self.least(states[who], node)
                ok = (self.count[node] > 0) & ((least < far[who]) | ((least == far[who]) & (apart <= gap[who])))
                ok &= ~((low >= p - radius) & (high <= p + radius))  # all of its rows are within the radius
                who, node = who[ok], node[ok]
                if level < int(self.leaves).bit_length() - 1:
                    who, node = np.repeat(who, 2), np.column_stack((2 * node + 1, 2 * node + 2)).ravel()
            yield who, node - len(self.axis)

    def bound(self, states: np.ndarray, wanted: int) -> np.ndarray:
        """A distance within which each state has ``wanted`` rows at least, infinite if there are not so many: by the boxes' far corners."""
        leaf = np.flatnonzero(self.count[len(self.axis) :]) + len(self.axis)
        out = np.full(len(states), np.inf)
        step = max(1, FRONTIER // max(1, len(leaf)))
        for at in range(0, len(states), step):
            a = states[at : at + step]
            total = np.zeros((len(a), len(leaf)))
            for j in range(states.shape[1]):
                diff = np.maximum(np.abs(a[:, j, None] - self.low[leaf, j]), np.abs(a[:, j, None] - self.high[leaf, j]))
                total += diff * diff
            order = np.argsort(total, axis=1)
            enough = np.cumsum(self.count[leaf][order], axis=1) >= wanted
            here = np.flatnonzero(enough.any(axis=1))
            at_leaf = order[here, enough[here].argmax(axis=1)]
            out[at + here] = np.sqrt(total[here, at_leaf])
        return out


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Of arrays (i, j, d, gap, l), the k first of each i by (d, gap, l)."""
    i, j, d, gap, rows = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((rows, gap, d, i))
    i = i[order]
    order = order[np.arange(len(i)) - np.searchsorted(i, i) < k]
    return tuple(np.concatenate(x)[order] for x in zip(*found, strict=True))


def _last(i: np.ndarray, d: np.ndarray, gap: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance and row difference of the k-th of each of n, infinite where there are fewer; i is sorted."""
    far, apart = np.full(n, np.inf), np.full(n, np.inf)
    end = np.searchsorted(i, np.arange(n), side="right")
    full = np.flatnonzero(end - np.searchsorted(i, np.arange(n)) >= k)
    far[full], apart[full] = d[end[full] - 1], gap[end[full] - 1]
    return far, apart


def boxed_nearest(p_rows: np.ndarray, p: np.ndarray, l_rows: np.ndarray, lib: np.ndarray, k: int, radius: int, far: np.ndarray | None = None, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As :func:`kernels.nearest`, by a tree of boxes over ``lib``, and the number of pairs worked out.

    ``far`` and ``gap`` bound what is wanted of each row: nothing after that (distance, row difference).
    """
    if len(lib) <= 2 * LEAF or not len(p):
        i, j, d = nearest(p_rows, p, l_rows, lib, k, radius)
        pairs = len(p) * len(lib)
        return i, j, d, pairs
    depth = max(1, int(np.ceil(np.log2(len(lib) / LEAF))))
    tree = Boxes.grow(lib, l_rows, depth)
    leaf = tree.leaf(lib, l_rows)
    tree.fit_rows(leaf, lib, l_rows)
    order = np.argsort(leaf, kind="stable")
    ends = np.cumsum(np.bincount(leaf, minlength=tree.leaves))
    starts = np.concatenate(([0], ends[:-1]))
    pairs, none = 0, (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0), np.zeros(0, int))

    def search(who: np.ndarray, where: np.ndarray) -> list[tuple]:
        """The k first of each asked leaf, one leaf at a time."""
        nonlocal pairs
        if not len(who):
            return []
        out, by = [], np.argsort(where, kind="stable")
        names, first = np.unique(where[by], return_index=True)
        for x, asked in zip(names.tolist(), np.split(who[by], first[1:]), strict=True):
            own = order[starts[x] : ends[x]]
            if not len(own):
                continue
            pairs += len(asked) * len(own)
            i, j, d = nearest(p_rows[asked], p[asked], l_rows[own], lib[own], k, radius)
            i, j = asked[i], own[j]
            out.append((i, j, d, np.abs(p_rows[i] - l_rows[j]).astype(float), l_rows[j]))
        return out

    home = tree.leaf(p, p_rows)
    at_home = _best([none, *search(np.arange(len(p)), home)], k)
    bound, apart = _last(at_home[0], at_home[2], at_home[3], len(p), k)
    short = np.flatnonzero(np.isinf(bound))
    if len(short):
        bound[short] = tree.bound(p[short], k + 2 * radius + 1)
    if far is not None:
        closer = (far < bound) | ((far == bound) & (gap < apart))
        bound, apart = np.where(closer, far, bound), np.where(closer, gap, apart)
    found = [none, at_home]
    for who, where in tree.reach(p, p_rows, bound, apart, radius):
        away = where != home[who]
        found += search(who[away], where[away])
    i, j, d, _, _ = _best(found, k)
    return i, j, d, pairs
