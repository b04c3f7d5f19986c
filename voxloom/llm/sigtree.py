"""Signature trees over sets, and their dual traversal for a Jaccard join.

A set is a sorted array of 64-bit tokens. Its bitmap has a bit for each token
(modulo `BITS`). A node of the tree holds the OR and the AND of its sets'
bitmaps and the range of their sizes. For x under node A and y under node B,
the bits that all sets of A have and none of B has stand for as many tokens of x
outside y at least, so the largest possible overlap of the two nodes is

    min(maxsize(A) - |and(A) & ~or(B)|, maxsize(B) - |and(B) & ~or(A)|)

and a pair of nodes is left as soon as this is below the overlap that the least
sizes need. Components are merged while the trees are walked, and a pair of
nodes whose sets all are in one component is left as well, so a large group of
near copies costs about one comparison a set.
"""

from __future__ import annotations

import numpy as np

BITS, LEAF, FAN = 2048, 16, 8


def links(x: np.ndarray, y: np.ndarray, num: int) -> bool:
    """Whether 100 * |x & y| >= num * |x | y|."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < num * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= num * (len(x) + len(y) - both)


class SignatureTree:
    """A tree over places of `sets`, ordered by size class and least token so that near copies are neighbours."""

    def __init__(self, sets: list[np.ndarray], places: np.ndarray) -> None:
        size = np.array([len(sets[p]) for p in places], np.int64)
        order = np.lexsort(([int(sets[p][0]) if len(sets[p]) else 0 for p in places], np.log(size + 1) // 0.08))
        self.places, self.size = places[order], size[order]
        self.bits = np.zeros((len(places), BITS // 64), np.uint64)
        for row, p in zip(self.bits, self.places, strict=True):
            bit = sets[p] % np.uint64(BITS)
            np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        #: levels from the leaves to the root: first place, end, OR, AND, least and largest size of each node
        self.levels = []
        starts = np.arange(0, len(places), LEAF)
        self._level(starts, np.minimum(starts + LEAF, len(places)), np.bitwise_or.reduceat(self.bits, starts), np.bitwise_and.reduceat(self.bits, starts), np.minimum.reduceat(self.size, starts), np.maximum.reduceat(self.size, starts))
        while len(self.levels[-1][0]) > 1:
            start, end, ors, ands, low, high = self.levels[-1]
            at = np.arange(0, len(start), FAN)
            self._level(start[at], end[np.minimum(at + FAN, len(start)) - 1], np.bitwise_or.reduceat(ors, at), np.bitwise_and.reduceat(ands, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at))

    def _level(self, *columns: np.ndarray) -> None:
        self.levels.append(columns)

    def below(self, level: int, k: int) -> range:
        return range(k * FAN, min((k + 1) * FAN, len(self.levels[level - 1][0])))


def join(sets: list[np.ndarray], label: np.ndarray, num: int, left: np.ndarray | None = None, right: np.ndarray | None = None) -> None:
    """Merges the labels (in place, to the lesser) of all linked sets among places left (all unless given), or between left and right."""
    left = np.arange(len(sets)) if left is None else left
    if not len(left) or right is not None and not len(right):
        return

    def pairs(a: np.ndarray, b: np.ndarray, a_bits: np.ndarray | None, b_bits: np.ndarray | None, same: bool) -> None:
        size = np.array([len(sets[p]) for p in b], np.int64)
        for i, p in enumerate(a):
            n = len(sets[p])
            fit = (label[b] != label[p]) & (100 * np.minimum(size, n) >= num * np.maximum(size, n))
            if same:
                fit[: i + 1] = False
            if b_bits is not None and fit.any():
                fit &= (100 + num) * np.bitwise_count(b_bits ^ a_bits[i]).sum(axis=1, dtype=np.int64) <= (100 - num) * (size + n)
            for q in b[fit]:
                if label[p] != label[q] and links(sets[p], sets[q], num):
                    low, high = sorted((label[p], label[q]))
                    label[label == high] = low

    if right is None and len(left) <= LEAF:  # one leaf
        return pairs(left, left, None, None, True)
    one = SignatureTree(sets, left)
    two = one if right is None else SignatureTree(sets, right)
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        i, a, j, b = stack.pop()
        a0, a1, a_or, a_and, a_low, a_high = (c[a] for c in one.levels[i])
        b0, b1, b_or, b_and, b_low, b_high = (c[b] for c in two.levels[j])
        if 100 * a_high < num * b_low or 100 * b_high < num * a_low:
            continue
        most = min(a_high - int(np.bitwise_count(a_and & ~b_or).sum()), b_high - int(np.bitwise_count(b_and & ~a_or).sum()))
        if (100 + num) * most < num * (a_low + b_low):
            continue
        a_places, b_places = one.places[a0:a1], two.places[b0:b1]
        if (label[a_places] == label[a_places[0]]).all() and (label[b_places] == label[a_places[0]]).all():
            continue
        same = one is two and i == j and a == b
        if i == 0 and j == 0:
            pairs(a_places, b_places, one.bits[a0:a1], two.bits[b0:b1], same)
        elif same:
            part = list(one.below(i, a))
            stack += [(i - 1, x, i - 1, y) for k, x in enumerate(part) for y in part[k + 1 :]]
            stack += [(i - 1, x, i - 1, x) for x in part]  # taken first: they merge most
        elif j == 0 or i >= j and i > 0:
            stack += [(i - 1, x, j, b) for x in one.below(i, a)]
        else:
            stack += [(i, a, j - 1, y) for y in two.below(j, b)]
    return None
