"""R-tree over count vectors, for pairs of sets whose overlap can reach a share of their union.

Elements are hashed into groups; a set's point has one coordinate a group, the
number of its elements there.  Two sets share at most the sum of the coordinates'
minima, and two boxes' sets at most the sum of the minima of the boxes' upper
corners: a pair of boxes whose bound is below what the sizes ask for holds no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 24
FANOUT = 4


def counts(elements: np.ndarray, groups: int) -> np.ndarray:
    """The point of a set of 64-bit hashes; groups is a power of two and halving it adds up halves of the point."""
    return np.bincount((elements >> np.uint64(40)).astype(np.int64) & (groups - 1), minlength=groups)


def groups_for(n: int, each: float, least: int = 16) -> int:
    """A power of two with at most ``each`` elements of n in a group, on average."""
    g = least
    while g * each < n:
        g *= 2
    return g


def fold(points: np.ndarray, groups: int) -> np.ndarray:
    while points.shape[1] > groups:
        half = points.shape[1] // 2
        points = points[:, :half] + points[:, half:]
    return points


class Node:
    __slots__ = ("upper", "low", "high", "children", "rows")

    def __init__(self, points: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> None:
        self.upper = points[rows].max(axis=0)
        self.low, self.high = int(sizes[rows].min()), int(sizes[rows].max())
        self.children: list[Node] = []
        self.rows = rows


def _tiles(points: np.ndarray, rows: np.ndarray, n: int) -> list[np.ndarray]:
    """rows cut into n tiles along the coordinates that vary most."""
    if n == 1 or len(rows) <= LEAF:
        return [rows]
    here = points[rows].astype(np.float32)
    along = int(here.var(axis=0).argmax())
    rows = rows[np.argsort(here[:, along], kind="stable")]
    half = len(rows) // 2
    return _tiles(points, rows[:half], n // 2) + _tiles(points, rows[half:], n // 2)


def build(points: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> Node:
    """A packed tree: each node's points are tiled into FANOUT children, down to leaves of LEAF."""
    node = Node(points, sizes, rows)
    if len(rows) > LEAF:
        node.children = [build(points, sizes, x) for x in _tiles(points, rows, FANOUT)]
    return node


def surviving(a: Node, b: Node, points_a: np.ndarray, points_b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, num: int, den: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (rows of a, rows of b) that num / den of similarity can't be ruled out for; own: a and b are one tree, each pair once."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if den * x.high < num * y.low or den * y.high < num * x.low:
            continue
        if not (own and x is y) and (num + den) * int(np.minimum(x.upper, y.upper).sum(dtype=np.int64)) < num * (x.low + y.low):
            continue
        if x.children or y.children:
            if own and x is y:
                stack += [(x.children[i], x.children[j]) for i in range(len(x.children)) for j in range(i + 1)]
            elif x.children and (not y.children or len(x.rows) >= len(y.rows)):
                stack += [(c, y) for c in x.children]
            else:
                stack += [(x, c) for c in y.children]
            continue
        p, q = points_a[x.rows], points_b[y.rows]
        bound = np.minimum(p[:, None, :], q[None, :, :]).sum(axis=2, dtype=np.int64)
        m, n = sizes_a[x.rows][:, None], sizes_b[y.rows][None, :]
        keep = ((num + den) * bound >= num * (m + n)) & (den * m >= num * n) & (den * n >= num * m)
        if own and x is y:
            keep &= np.arange(len(x.rows))[:, None] > np.arange(len(y.rows))[None, :]
        i, j = np.nonzero(keep)
        if len(i):
            yield x.rows[i], y.rows[j]


def candidate_pairs(points: list[np.ndarray], sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets, each once, that may reach num / den; points may differ in their number of groups.

    Sets are taken by number of groups, one tree each; trees of which no two sets'
    sizes fit are not compared.
    """
    groups = np.array([len(p) for p in points])
    trees = []
    for g in np.unique(groups):
        rows = np.flatnonzero(groups == g)
        own = np.stack([points[r] for r in rows])
        trees.append((rows, own, sizes[rows]))
    for k, (rows, own, n) in enumerate(trees):
        tree = build(own, n, np.arange(len(rows)))
        for i, j in surviving(tree, tree, own, own, n, n, num, den, True):
            yield rows[i], rows[j]
        for rows2, own2, n2 in trees[k + 1 :]:
            if den * n.max() < num * n2.min() or den * n2.max() < num * n.min():
                continue
            folded = fold(own2, own.shape[1])
            for i, j in surviving(tree, build(folded, n2, np.arange(len(rows2))), own, folded, n, n2, num, den, False):
                yield rows[i], rows2[j]


def trees(points: list[np.ndarray], sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, Node]]:
    """Sets by number of groups: their rows, points, sizes and tree."""
    groups = np.array([len(p) for p in points])
    out = []
    for g in np.unique(groups):
        rows = np.flatnonzero(groups == g)
        own = np.stack([points[r] for r in rows])
        out.append((rows, own, sizes[rows], build(own, sizes[rows], np.arange(len(rows)))))
    return out


def pairs_between(a: list, b: list, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of a, row of b) of sets that may reach num / den; a and b as ``trees`` gives them."""
    for rows, own, n, tree in a:
        for rows2, own2, n2, tree2 in b:
            if den * n.max() < num * n2.min() or den * n2.max() < num * n.min():
                continue
            least = min(own.shape[1], own2.shape[1])
            p, q = fold(own, least), fold(own2, least)
            x = tree if p is own else build(p, n, np.arange(len(rows)))
            y = tree2 if q is own2 else build(q, n2, np.arange(len(rows2)))
            for i, j in surviving(x, y, p, q, n, n2, num, den, False):
                yield rows[i], rows2[j]
