"""Connected components of an edge table, by alternating large and small stars.

Each round first contracts the edges within tasks of EDGES, where a union-find makes
stars of them; where all fit into one task, that is the end.  Then it gives every
node's greater neighbours, and its smaller ones, to the smallest node it sees; the
number of rounds grows with the logarithm of the longest path.  No node's neighbours
are gathered: their minimum is a partial aggregate, and the join back is one that Spark
can split where a node is hot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quick_partitions, tidy
from .shared import settled as written

#: Edges that a task contracts, about.
EDGES = 100_000


class Forest:
    """Union-find over the numbers 0 to n - 1; the smaller root wins."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if y < x:
            x, y = y, x
        self.parent[y] = x
        return True


def _star(ends: list[np.ndarray]) -> pa.RecordBatch:
    """Edges as a star from the smallest node of each of their components."""
    nodes, at = np.unique(np.concatenate(ends, 1), return_inverse=True)
    at = at.reshape(2, -1)
    forest = Forest(len(nodes))
    for x, y in zip(at[0].tolist(), at[1].tolist()):
        forest.join(x, y)
    roots = np.array([forest.find(x) for x in range(len(nodes))], np.int64)
    other = np.flatnonzero(roots != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[roots[other]])], ["a", "b"])


def _contracted(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's edges as stars, of ``most`` edges together where it has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: list[np.ndarray] = []
        for batch in batches:
            ends.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            if sum(e.shape[1] for e in ends) > most:
                yield _star(ends)
                ends = []
        if ends:
            yield _star(ends)

    return run


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long), root being its component's smallest node.

    Loops and repeated edges do no harm; an empty table gives an empty one; edges
    with a null end are left out.
    """
    kind = "a long, b long"
    start = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    now = written(start.mapInArrow(tidy(_contracted(EDGES)), kind).distinct(), f"{name}-0")
    mark, step, rows = None, 0, now.count()
    while rows:
        step, tasks = step + 1, quick_partitions(edges.sparkSession, rows, EDGES)
        if tasks == 1:
            now = written(now.coalesce(1).mapInArrow(tidy(_contracted(2 * EDGES)), kind), f"{name}-{step}")
            break
        # a task may get twice its share
        star = now.repartition(tasks, "b").mapInArrow(tidy(_contracted(2 * EDGES)), kind)
        now = written(star.distinct(), f"{name}-{step}-stars")
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", "m")).distinct()
        now = written(small, f"{name}-{step}")
        stats = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        rows = stats.n
        if (stats.n, stats.h) == mark:
            break
        mark = (stats.n, stats.h)
    roots = now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
