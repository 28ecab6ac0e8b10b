"""Forests of BK-trees over 64-bit fingerprints, built and searched level by level with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class BKForest:
    """One BK-tree for each group: a node's children are keyed by their Hamming distance to it.

    ``fingerprints`` (uint64) and ``groups`` (int) are parallel; all rows of a level are
    placed at once: the first row of each open cell becomes its node, and the others
    go to cells keyed by (node, distance).  Equal fingerprints chain along edge 0.
    """

    def __init__(self, fingerprints: np.ndarray, groups: np.ndarray):
        self.fp = np.asarray(fingerprints, np.uint64)
        n = len(self.fp)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        rows = np.argsort(groups, kind="stable")
        cell = np.asarray(groups)[rows]
        owner = np.full(n, -1, np.int64)  # of each row in ``rows``: its cell's parent node
        dist = np.zeros(n, np.int64)
        roots = None
        while len(rows):
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[start, len(cell)])
            heads = rows[start]
            parent[heads], edge[heads] = owner[start], dist[start]
            if roots is None:
                roots = (cell[start], heads)
            head_of = np.repeat(heads, sizes)
            rest = np.ones(len(rows), bool)
            rest[start] = False
            rows, head_of = rows[rest], head_of[rest]
            d = np.bitwise_count(self.fp[rows] ^ self.fp[head_of]).astype(np.int64)
            key = head_of * 65 + d
            order = np.argsort(key, kind="stable")
            rows, owner, dist, cell = rows[order], head_of[order], d[order], key[order]
        self.roots = dict(zip(roots[0].tolist(), roots[1].tolist())) if roots else {}
        child = np.flatnonzero(parent >= 0)
        key = parent[child] * 65 + edge[child]
        order = np.argsort(key, kind="stable")
        self._key, self._child = key[order], child[order]

    def search(self, fingerprints: np.ndarray, groups: np.ndarray, radius: int, frontier: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays (query, node) within ``radius``, of each query in its group's tree.

        Only edges from distance - radius to distance + radius are followed.  Ranges of
        children are kept and opened ``frontier`` nodes at a time, depth first, so memory
        is bounded by frontier x depth.
        """
        fp = np.asarray(fingerprints, np.uint64)
        root = np.array([self.roots.get(g, -1) for g in np.asarray(groups).tolist()], np.int64)
        has = np.flatnonzero(root >= 0)
        for start in range(0, len(has), frontier):
            q = has[start : start + frontier]
            visited = [(q, root[q])]
            waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while visited or waiting:
                if not visited:
                    q, lo, n = waiting.pop()
                    ends = np.cumsum(n)
                    first = max(1, int(np.searchsorted(ends, frontier, "right")))
                    if first < len(q):
                        waiting.append((q[first:], lo[first:], n[first:]))
                    q, lo, n = q[:first], lo[:first], n[:first]
                    at = np.repeat(lo - np.r_[0, ends[: first - 1]], n) + np.arange(int(ends[first - 1]))
                    visited.append((np.repeat(q, n), self._child[at]))
                q, node = visited.pop()
                d = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
                near = d <= radius
                if near.any():
                    yield q[near], node[near]
                lo = np.searchsorted(self._key, node * 65 + np.maximum(d - radius, 0), "left")
                n = np.searchsorted(self._key, node * 65 + np.minimum(d + radius, 64), "right") - lo
                if (some := n > 0).any():
                    waiting.append((q[some], lo[some], n[some]))


class Union:
    """Union-find over 0..n-1; the smaller root wins."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return int(x)

    def roots(self, x: np.ndarray) -> np.ndarray:
        p = self.parent
        r = p[x]
        while not np.array_equal(nxt := p[r], r):
            r = nxt
        return r

    def join(self, a: int, b: int) -> bool:
        """True if they were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True

    def join_all(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Join pairs; those that joined two sets are returned (a forest of the links given)."""
        made = []
        ra, rb = self.roots(a), self.roots(b)
        apart = ra != rb
        if not apart.any():
            return made
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        _, first = np.unique(np.minimum(ra, rb) * len(self.parent) + np.maximum(ra, rb), return_index=True)
        for i in first.tolist():
            if self.join(int(a[i]), int(b[i])):
                made.append((int(a[i]), int(b[i])))
        return made
