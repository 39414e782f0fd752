"""Geometric near-neighbour access tree over a few integer points, searched for whole batches of queries at once.

A node holds split points; every other point of the node belongs to its nearest one. For each pair of a split point and a
group the node keeps the least and largest distance between them. A query's distance to a split point then bounds its
distance to every group by the triangle inequality, and a group goes, with all its subtree, when that bound is strictly
beyond the best distance so far. Bounds are rounded against elimination; what is left is compared by integer squared
distances, equal ones by the lower index, so the result is that of a full scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

DEGREE, LEAF = 6, 6
#: Rows of a batch whose distances to one node are held at once.
ROWS = 1 << 15
#: Covers the rounding of a square root, a product and a difference of doubles.
SLACK = 2.0**-46


@dataclass
class Node:
    """Points compared here (ascending index), groups below, and the ranges of distances from each point to each group."""

    points: np.ndarray
    groups: list[tuple[int, Node]] = field(default_factory=list)
    least: np.ndarray | None = None
    most: np.ndarray | None = None


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer squared distances of all rows of ``a`` to all rows of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        off = a[:, i, None] - b[None, :, i]
        out += off * off
    return out


class Gnat:
    """Tree over ``points`` (int64 rows; entries small enough that squared distances fit a long)."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, leaf: int = LEAF):
        self.points, self.degree, self.leaf = np.asarray(points, np.int64), max(2, degree), max(1, leaf)
        self.root = self._node(np.arange(len(self.points)))
        #: Distances computed so far; a full scan would take ``len(queries) * len(points)``.
        self.compared = 0

    def _node(self, ids: np.ndarray) -> Node:
        if len(ids) <= self.leaf:
            return Node(ids)
        chosen = [0]
        apart = squares(self.points[ids], self.points[ids[:1]])[:, 0]
        while len(chosen) < self.degree and apart.max() > 0:  # the point farthest from all chosen comes next
            chosen.append(int(apart.argmax()))
            apart = np.minimum(apart, squares(self.points[ids], self.points[ids[chosen[-1:]]])[:, 0])
        if len(chosen) == 1:  # all equal: the lowest index answers for all
            return Node(ids[:1])
        splits = np.sort(ids[chosen])
        rest = np.setdiff1d(ids, splits)
        distance = squares(self.points[rest], self.points[splits])
        owner = distance.argmin(1)
        node = Node(splits)
        least, most = [], []
        for j in range(len(splits)):
            own = owner == j
            if own.any():
                node.groups.append((j, self._node(rest[own])))
                far = np.sqrt(distance[own].astype(float))
                least.append(far.min(0) * (1 - SLACK))
                most.append(far.max(0) * (1 + SLACK))
        if node.groups:
            node.least, node.most = np.array(least), np.array(most)
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest point (equal distances: the lowest) and its squared distance, for each row."""
        queries = np.asarray(queries, np.int64)
        best = np.full(len(queries), np.iinfo(np.int64).max)
        at = np.full(len(queries), len(self.points), np.int64)
        for start in range(0, len(queries), ROWS):
            self._visit(self.root, np.arange(start, min(start + ROWS, len(queries))), queries, best, at)
        return at, best

    def _visit(self, node: Node, rows: np.ndarray, queries: np.ndarray, best: np.ndarray, at: np.ndarray) -> None:
        found = squares(queries[rows], self.points[node.points])
        self.compared += found.size
        near = found.argmin(1)
        value, index = found[np.arange(len(rows)), near], node.points[near]
        better = (value < best[rows]) | ((value == best[rows]) & (index < at[rows]))
        best[rows[better]], at[rows[better]] = value[better], index[better]
        if not node.groups:
            return
        away = np.sqrt(found.astype(float))
        low, high = away * (1 - SLACK), away * (1 + SLACK)
        for own in (True, False):  # the nearest split point's group first: it narrows the radius for the others
            for k, (j, group) in enumerate(node.groups):
                asked = np.flatnonzero((near == j) == own)
                if not len(asked):
                    continue
                radius = np.sqrt(best[rows[asked]].astype(float)) * (1 + SLACK)
                bound = np.maximum(low[asked] - node.most[k], node.least[k] - high[asked]).max(1)
                left = asked[bound * (1 - SLACK) <= radius]
                if len(left):
                    self._visit(group, rows[left], queries, best, at)
