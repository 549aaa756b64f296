"""A succinct trie in level order: one bit vector (LOUDS) and a label for each node.

The bit vector lists the nodes level by level; each stands as as many ones as it has
children, then a zero. A super-root comes first, so a forest is a trie, too. The j-th one
is the edge to node j, and the zeros before it tell its parent.
"""

from __future__ import annotations

import numpy as np


class Louds:
    def __init__(self, bits: np.ndarray, labels: np.ndarray, levels: np.ndarray):
        self.n = len(labels)
        self.packed = np.packbits(bits)
        self.labels = labels
        self.levels = levels  # where each level begins, and the number of nodes

    @classmethod
    def of(cls, parent: np.ndarray, depth: np.ndarray, labels: np.ndarray) -> tuple[Louds, np.ndarray]:
        """The trie of nodes given by the index of their parent (-1: below the super-root) and their depth; and the nodes' order in it."""
        n = len(parent)
        by_depth = np.argsort(depth, kind="stable")
        levels = np.append(np.searchsorted(depth[by_depth], np.arange(depth.max() + 1 if n else 0)), n)
        rank, order = np.full(n + 1, -1, np.int64), np.empty(n, np.int64)  # rank[-1]: the super-root's
        for lo, hi in zip(levels[:-1], levels[1:]):
            here = by_depth[lo:hi]
            here = here[np.argsort(rank[parent[here]], kind="stable")]
            order[lo:hi] = here
            rank[here] = np.arange(lo, hi)
        degree = np.bincount(rank[parent] + 1, minlength=n + 1)
        bits = np.ones(2 * n + 1, bool)
        bits[np.cumsum(degree) + np.arange(n + 1)] = False
        return cls(bits, labels[order], levels), order

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=2 * self.n + 1).astype(bool)

    def parents(self) -> np.ndarray:
        """The parent of each node in level order, -1 for the super-root."""
        ones = np.flatnonzero(self.bits())
        return ones - np.arange(self.n) - 1

    def degrees(self) -> np.ndarray:
        """The number of children of each node."""
        zeros = np.flatnonzero(~self.bits())
        return np.diff(zeros) - 1

    def rollup(self, *values: np.ndarray) -> list[np.ndarray]:
        """Sums over each node's subtree, by the levels from the last to the first."""
        parents, out = self.parents(), [v.astype(np.int64) for v in values]
        for lo, hi in zip(self.levels[-2:0:-1], self.levels[:0:-1]):
            for v in out:
                np.add.at(v, parents[lo:hi], v[lo:hi])
        return out
