"""Cover trees over unit vectors, and the dual traversal that finds all pairs within a distance.

A level's centres are farther apart than its radius, which is half of the level above's; the
centre of a node is also the centre of its first child. Every node knows the true distance of its
farthest member, so two nodes are left as soon as their centres are too far apart for any pair,
and taken whole as soon as all pairs must be near enough.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Nodes of at most so many members aren't divided.
LEAF = 32
#: Radius of the level below the root; unit vectors are at most 2 apart.
WIDEST = 1.0
#: Rows of a table of distances that is held at once.
ROWS = 512
#: Rounding that bounds on distances allow for: next to zero a distance has half of a product's digits.
SLACK = 1e-7
#: Products this near to the threshold are summed without rounding.
NEAR = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` in double precision, each of length one; none may be zero."""
    large = vectors.astype(np.float64)
    large /= np.abs(large).max(axis=1, keepdims=True)
    return large / np.linalg.norm(large, axis=1, keepdims=True)


def _distances(products: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * products, 0))


class CoverTree:
    """Nodes by number; node 0 holds all. The members of a node are a run of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.run: list[tuple[int, int]] = []
        self.children: list[np.ndarray | None] = []
        todo = [(self._node(0, len(points), 0, self._far(0, np.arange(len(points)))), WIDEST)]
        while todo:
            node, width = todo.pop()
            start, end = self.run[node]
            if end - start > leaf and self.radius[node] > SLACK:
                while width >= self.radius[node]:
                    width /= 2
                todo += [(child, width / 2) for child in self._divide(node, width)]
        self.centres = points[self.centre]
        self.radii = np.array(self.radius)
        self.sizes = np.array([end - start for start, end in self.run])

    def _far(self, centre: int, members: np.ndarray) -> np.ndarray:
        # A difference of points stays exact where they are close.
        return np.linalg.norm(self.points[members] - self.points[centre], axis=1)

    def _node(self, start: int, end: int, centre: int, far: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(far.max(initial=0.0)))
        self.run.append((start, end))
        self.children.append(None)
        return len(self.centre) - 1

    def _divide(self, node: int, width: float) -> list[int]:
        """Children whose centres are more than ``width`` apart, each with the members within it."""
        start, end = self.run[node]
        members = self.order[start:end].copy()
        points = self.points[members]
        free = np.ones(len(members), bool)
        least = 1 - width * width / 2
        made, at = [], start
        centre = int(np.flatnonzero(members == self.centre[node])[0])
        while True:
            near = free & (points @ points[centre] >= least)
            near[centre] = True
            mine = np.append(members[centre], members[near & (np.arange(len(members)) != centre)])
            self.order[at : at + len(mine)] = mine
            made.append(self._node(at, at + len(mine), int(mine[0]), self._far(mine[0], mine)))
            at += len(mine)
            free &= ~near
            if at == end:
                break
            if 2 * (end - at) < len(members):
                members, points, free = members[free], points[free], free[free]
            centre = int(np.argmax(free))
        self.children[node] = np.array(made)
        return made

    def members(self, node: int) -> np.ndarray:
        start, end = self.run[node]
        return self.order[start:end]

    def below(self, node: int) -> np.ndarray:
        """The node's children, or itself if it has none."""
        children = self.children[node]
        return np.array([node]) if children is None else children


class Links:
    """What a traversal found: neighbours of every point, and edges that join what is linked."""

    def __init__(self, one: CoverTree, two: CoverTree, weights: tuple[np.ndarray, np.ndarray]):
        self.weights = weights
        self.counts = (np.zeros(len(one.points), np.int64), np.zeros(len(two.points), np.int64))
        self.edges: list[np.ndarray] = []

    def all_of(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every member of ``a`` is linked to every one of ``b``."""
        self.counts[0][a] += self.weights[1][b].sum()
        self.counts[1][b] += self.weights[0][a].sum()
        self.edges.append(np.stack([a, np.full(len(a), b[0])]))
        self.edges.append(np.stack([np.full(len(b), a[0]), b]))

    def some(self, a: np.ndarray, b: np.ndarray) -> None:
        """a[i] is linked to b[i], each such pair once."""
        np.add.at(self.counts[0], a, self.weights[1][b])
        np.add.at(self.counts[1], b, self.weights[0][a])
        self.edges.append(np.stack([a, b]))


def _decided(one: CoverTree, two: CoverTree, a: np.ndarray, b: np.ndarray, products: np.ndarray, cosine: float) -> np.ndarray:
    """Which products reach ``cosine``; those next to it are summed without rounding first."""
    linked = products >= cosine
    for i, j in zip(*np.nonzero(np.abs(products - cosine) <= NEAR), strict=True):
        x, y = one.points[a[i]].tolist(), two.points[b[j]].tolist()
        size = math.sqrt(math.fsum(v * v for v in x) * math.fsum(v * v for v in y))
        linked[i, j] = math.fsum(u * v for u, v in zip(x, y, strict=True)) / size >= cosine
    return linked


def _compare(one: CoverTree, two: CoverTree, a: np.ndarray, b: np.ndarray, cosine: float, links: Links, own: bool) -> None:
    """All pairs of two leaves' members; ``own`` says that both are the same leaf of one tree."""
    for start in range(0, len(a), ROWS):
        part = a[start : start + ROWS]
        linked = _decided(one, two, part, b, one.points[part] @ two.points[b].T, cosine)
        if own:
            linked &= np.arange(len(b))[None, :] > np.arange(start, start + len(part))[:, None]
        i, j = np.nonzero(linked)
        if len(i):
            links.some(part[i], b[j])


def _pairs(one: CoverTree, two: CoverTree, a: np.ndarray, b: np.ndarray, most: float, cosine: float, links: Links, own: bool) -> Iterator[tuple[int, int]]:
    """Pairs of the nodes ``a`` and ``b`` that must be looked into; what bounds decide goes to ``links``."""
    single_b = two.sizes[b] == 1
    for start in range(0, len(a), ROWS):
        part = a[start : start + ROWS]
        products = one.centres[part] @ two.centres[b].T
        between = _distances(products)
        spread = one.radii[part][:, None] + two.radii[b][None, :]
        alive = between - spread <= most + SLACK
        if own:
            alive &= np.arange(len(b))[None, :] > np.arange(start, start + len(part))[:, None]
        points = (one.sizes[part] == 1)[:, None] & single_b[None, :] & alive
        if points.any():
            i, j = np.nonzero(points)
            x, y = np.unique(i), np.unique(j)
            ca, cb = one.order[[one.run[n][0] for n in part[x]]], two.order[[two.run[n][0] for n in b[y]]]
            linked = _decided(one, two, ca, cb, products[np.ix_(x, y)], cosine) & points[np.ix_(x, y)]
            i, j = np.nonzero(linked)
            if len(i):
                links.some(ca[i], cb[j])
        whole = alive & ~points & (between + spread <= most - SLACK)
        for i, j in zip(*np.nonzero(whole), strict=True):
            links.all_of(one.members(part[i]), two.members(b[j]))
        for i, j in zip(*np.nonzero(alive & ~points & ~whole), strict=True):
            yield int(part[i]), int(b[j])


def traverse(one: CoverTree, two: CoverTree, cosine: float, weights: tuple[np.ndarray, np.ndarray]) -> Links:
    """All links between two trees, or within one that is given twice: every pair is counted once.

    ``weights`` are how many rows each point stands for. Within one tree a point's link to
    itself isn't counted, and both counts belong to the same points.
    """
    most = math.sqrt(2 - 2 * cosine)
    links = Links(one, two, weights)
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        own = one is two and x == y
        if one.children[x] is None and two.children[y] is None:
            _compare(one, two, one.members(x), two.members(y), cosine, links, own)
            continue
        # Only the wider node is divided, or both where they are about as wide.
        split_x = two.children[y] is None or (one.children[x] is not None and one.radius[x] * 2 >= two.radius[y])
        split_y = one.children[x] is None or (two.children[y] is not None and two.radius[y] * 2 >= one.radius[x])
        a = one.below(x) if split_x or own else np.array([x])
        b = two.below(y) if split_y or own else np.array([y])
        if own:
            todo += [(int(child), int(child)) for child in a if one.sizes[child] > 1]
        todo += _pairs(one, two, a, b, most, cosine, links, own)
    return links


def joined(edges: list[np.ndarray], count: int) -> np.ndarray:
    """The least point each of ``count`` points is joined to by edges between them."""
    least = np.arange(count)
    if not edges:
        return least
    a, b = np.unique(np.concatenate(edges, axis=1), axis=1)
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, least[a], low)
        np.minimum.at(least, least[b], low)
        least = least[least]
        if np.array_equal(before, least):
            return least
