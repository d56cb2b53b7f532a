"""Approximate nearest neighbours by inner product, with a vantage-point tree per shard.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) for the greatest norm M, and queries
a 0 there: the Euclidean distance then orders them as the inner product does, and the
triangle inequality holds.  A subtree knows the least and greatest distance of its
points from its vantage point; a query passes it over if the distance it so must have
at least, times a factor, is beyond the query's k-th best.  Factor 1 is exact search.

The top of the tree is common: vantage points of a sample halve all vectors again and
again into regions, and each region's bounds are those of all its rows.  A region's
rows are dealt by hash to shards of bounded size, a tree each.  A query first searches
its own region; with the k-th best it has then, it goes on to those other regions that
its bounds do not rule out.  Of equal vectors only the k + 1 least ids can be in any
result, and equal queries are one search, so no repeated vector makes a task large.

Unless it is given, the factor is the greatest of FACTORS by which a tree of the sample
finds TARGET of what an exhaustive search of the sample finds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .shared import plain, table, tidy, written

#: Rows of a shard and queries that meet it in a task, about; a leaf's points; regions at most.
SHARD, QUERIES, LEAF, REGIONS = 16_384, 65_536, 128, 1024
#: Rows of hashes of repeated vectors up to which they are broadcast (16 bytes each).
BROADCAST_ROWS = 200_000
#: Rows, and bytes of vectors, of the sample that the regions' vantage points and the factor come from, about.
SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20
#: Factors that are tried, queries of the sample that try them, and the recall one must reach.
FACTORS, TRIALS, TARGET = (1.0, 1.05, 1.1, 1.2, 1.35, 1.5, 1.75, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 8.0, 10.0, 12.0), 128, 0.96


def lifted(vectors: np.ndarray, square: float) -> np.ndarray:
    return np.hstack([vectors, np.sqrt(np.maximum(square - (vectors**2).sum(1), 0))[:, None]])


def _far(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((points - vantage) ** 2).sum(1), 0))


class Tree:
    """Points of one shard in the order of their ids; nodes as (vantage, children, bounds) or a leaf's rows."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, vectors: np.ndarray, square: float, seed: int = 3) -> None:
        order = np.lexsort((marks, ids))
        self.ids, self.marks, self.vectors, self.square = ids[order], marks[order], vectors[order], square
        self.points = lifted(self.vectors, square)
        self.rng = np.random.default_rng(seed)
        self.scored = 0  #: pairs of a query and a row whose product was taken
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return np.sort(rows)
        vantage = self.points[self.rng.choice(rows)]
        far = _far(self.points[rows], vantage)
        order = np.argsort(far, kind="stable")  # halves by rank: equal points divide as well
        half = len(rows) // 2
        inner, outer = order[:half], order[half:]
        bounds = (far[inner].min(), far[inner].max(), far[outer].min(), far[outer].max())
        return vantage, self._build(rows[inner]), self._build(rows[outer]), bounds

    def search(self, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, rows) of each query's k best that reach its floor, best first, ties to the smaller id; -inf where there are fewer."""
        n = len(queries)
        floor = np.full(n, -np.inf) if floor is None else floor
        best, names = np.full((n, k), -np.inf), np.full((n, k), len(self.ids))
        norm = (queries**2).sum(1)
        points = np.hstack([queries, np.zeros((n, 1))])
        slack = 1e-9 * (1 + np.sqrt(self.square) + np.sqrt(norm))

        def least(of: np.ndarray) -> np.ndarray:
            return np.maximum(best[of, -1], floor[of])

        def reach(of: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(norm[of] + self.square - 2 * least(of), 0)) + slack[of]

        def visit(node, of: np.ndarray) -> None:
            if not len(of):
                return
            if isinstance(node, np.ndarray):
                # a row's worth of products at a time, each by the same sums whatever the batch
                scores = np.einsum("qd,pd->qp", queries[of], self.vectors[node])
                self.scored += scores.size
                better = scores.max(1) >= least(of)
                of, scores = of[better], scores[better]
                if len(of):
                    scores[scores < floor[of][:, None]] = -np.inf
                    both = np.hstack([best[of], scores])
                    called = np.hstack([names[of], np.broadcast_to(node, scores.shape)])  # rows are in the order of ids
                    order = np.lexsort((called, -both), axis=1)[:, :k]
                    best[of], names[of] = np.take_along_axis(both, order, 1), np.take_along_axis(called, order, 1)
                return
            vantage, inner, outer, (a, b, c, d) = node
            far = _far(points[of], vantage)
            at_inner = np.maximum(np.maximum(a - far, far - b), 0) * factor
            at_outer = np.maximum(np.maximum(c - far, far - d), 0) * factor
            near = at_inner <= at_outer
            for first, second, p, q, mine in ((inner, outer, at_inner, at_outer, near), (outer, inner, at_outer, at_inner, ~near)):
                visit(first, of[mine][p[mine] <= reach(of[mine])])
                visit(second, of[mine][q[mine] <= reach(of[mine])])

        if len(self.ids):
            visit(self.root, np.arange(n))
        return best, names


@dataclass
class Regions:
    """A complete tree of vantage points, a level after the other, over vectors of one length: node i has the children 2 i + 1 and 2 i + 2."""

    vantage: np.ndarray
    radius: np.ndarray
    levels: int
    low: np.ndarray | None = None  #: by region and level, the least distance of its rows from the vantage point there
    high: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray, levels: int, seed: int = 5) -> Regions:
        rng, parts = np.random.default_rng(seed), [np.arange(len(points))]
        vantage, radius = [], []
        for _ in range(levels):
            below = []
            for rows in parts:
                v = points[rng.choice(rows)]
                far = _far(points[rows], v)
                order = np.argsort(far, kind="stable")
                half = len(rows) // 2
                vantage.append(v), radius.append(far[order[half - 1]])
                below += [rows[order[:half]], rows[order[half:]]]
            parts = below
        return cls(np.array(vantage).reshape(-1, points.shape[1]), np.array(radius), levels)

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point's region, and its distances from the vantage points on its way."""
        at, far = np.zeros(len(points), np.int64), np.zeros((len(points), self.levels))
        for level in range(self.levels):
            far[:, level] = np.sqrt(np.maximum(((points - self.vantage[at]) ** 2).sum(1), 0))
            at = 2 * at + 1 + (far[:, level] > self.radius[at])
        return at - (2**self.levels - 1), far

    def visits(self, points: np.ndarray, reach: np.ndarray, factor: float) -> np.ndarray:
        """Whether each point's ball of so much reach, relaxed by the factor, may hold rows of each region."""
        out = np.ones((len(points), 2**self.levels), bool)
        if not self.levels or self.low is None or self.high is None:
            return out
        far = np.stack([_far(points, v) for v in self.vantage], 1)
        at = np.arange(2**self.levels) + 2**self.levels - 1
        for level in reversed(range(self.levels)):
            at = (at - 1) // 2
            d = far[:, at]
            gap = np.maximum(np.maximum(self.low[:, level] - d, d - self.high[:, level]), 0)
            out &= gap * factor <= reach[:, None]
        return out


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    lengths = batch.column(column).value_lengths().to_numpy()
    for length in np.unique(lengths):
        yield int(length), batch.filter(pa.array(lengths == length))


def _placed(regions: dict[int, Regions], square: float, query: bool):
    """Rows (a, b, id, vector) with length, region and the distances on the way; queries have no last coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, part in _by_length(batch, 3):
                vectors = _vectors(part.column(3))
                if length in regions:
                    points = np.hstack([vectors, np.zeros((len(vectors), 1))]) if query else lifted(vectors, square)
                    at, far = regions[length].place(points)
                else:
                    at, far = np.zeros(len(vectors), np.int64), np.zeros((len(vectors), 0))
                ends = np.arange(len(vectors) + 1) * far.shape[1]
                ways = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(vectors), length)), pa.array(at), ways], ["a", "b", "id", "vector", "length", "region", "far"])

    return run


def _others(regions: dict[int, Regions], square: float, factor: float):
    """From queries (a, b, vector, length, region, floor): each with the other regions it must go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, part in _by_length(batch, 2):
                if length not in regions:
                    continue
                for c in range(0, part.num_rows, 1024):
                    some = part.slice(c, 1024)
                    vectors, home, floor = _vectors(some.column(2)), some.column(4).to_numpy(), some.column(5).to_numpy()
                    norm = (vectors**2).sum(1)
                    reach = np.sqrt(np.maximum(norm + square - 2 * floor, 0)) + 1e-9 * (1 + np.sqrt(square) + np.sqrt(norm))
                    to = regions[length].visits(np.hstack([vectors, np.zeros((len(vectors), 1))]), reach, factor)
                    to[np.arange(len(home)), home] = False
                    rows, others = np.nonzero(to)
                    taken = some.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*taken.columns[:4], pa.array(others), taken.column(5)], ["a", "b", "vector", "length", "region", "floor"])

    return run


def _search(k: int, factor: float, square: float):
    """From rows (place, asks, a, b, id, vector, floor) in this order: a place's vectors, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, tree = None, [], None
        for batch in batches:
            places = batch.column(0).to_numpy()
            asks = batch.column(1).to_numpy(zero_copy_only=False)
            change = np.flatnonzero((places[1:] != places[:-1]) | (asks[1:] != asks[:-1])) + 1
            for first, last in zip([0, *change.tolist()], [*change.tolist(), len(places)]):
                if first == last:
                    continue
                part = batch.slice(first, last - first)
                if int(places[first]) != at:
                    at, waiting, tree = int(places[first]), [], None
                if not asks[first]:
                    waiting.append(part)
                    continue
                if not waiting:
                    continue
                if tree is None:
                    ids, marks = (np.concatenate([p.column(c).to_numpy() for p in waiting]) for c in (4, 2))
                    tree = Tree(ids, marks, np.vstack([_vectors(p.column(5)) for p in waiting]), square)
                for c in range(0, part.num_rows, 1024):
                    some = part.slice(c, 1024)
                    scores, rows = tree.search(_vectors(some.column(5)), k, factor, some.column(6).to_numpy())
                    query, rank = np.nonzero(scores > -np.inf)
                    rows = rows[query, rank]
                    key = some.take(pa.array(query))
                    yield pa.RecordBatch.from_arrays([key.column(2), key.column(3), pa.array(tree.ids[rows]), pa.array(tree.marks[rows]), pa.array(scores[query, rank])], ["a", "b", "vec_id", "mark", "score"])

    return run


def tuned_factor(sample: np.ndarray, square: float, k: int, target: float = TARGET) -> float:
    """The greatest of FACTORS that reaches the target on the sample, or 1."""
    if len(sample) <= max(LEAF, k):
        return 1.0
    tree = Tree(np.arange(len(sample)), np.arange(len(sample)), sample, square)
    asked = tree.vectors[:: max(1, len(sample) // TRIALS)][:TRIALS]
    exact, _ = tree.search(asked, k, 1.0)
    last = np.maximum(exact[:, -1], -np.finfo(np.float64).max)[:, None]

    def good(factor: float) -> bool:
        found, _ = tree.search(asked, k, factor)
        return float(np.minimum((found >= last).sum(1), k).mean()) >= target * k

    low, high = 0, len(FACTORS)  # the more is passed over, the less is found
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if good(FACTORS[middle]) else (low, middle)
    return FACTORS[low]


def nearest(vectors: DataFrame, queries: DataFrame | None = None, every: int = 20, k: int = 20, factor: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest of ``vectors`` by inner product, in double precision.

    Queries are the rows of ``queries``, or those of ``vectors`` whose id ``every``
    divides; a query's own row, the one with its id and vector, is no candidate.  Ties
    go to the smaller id.  Rows whose id or vector is null, or whose vector is empty,
    zero or holds a null, NaN or infinite component, take no part; vectors meet queries
    of their own length.  Rows that agree in id and vector count once; those of one id
    with different vectors are candidates each, and queries each, whose ranks all
    stand under that id.  A query without candidates has no rows, and an empty table
    gives an empty result; other columns are left out.
    """

    def valid(df: DataFrame) -> DataFrame:
        single = df.schema[vector_col].dataType == ArrayType(FloatType())  # as they are, half the bytes
        rows = plain(df, id=df[f"`{id_col}`"].cast("long"), vector=df[f"`{vector_col}`"] if single else df[f"`{vector_col}`"].cast("array<double>"))
        good = F.forall("vector", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("vector", lambda x: x != 0)
        rows = rows.where("id IS NOT NULL AND vector IS NOT NULL").where(good)
        # two hashes stand for a vector; equal vectors have both
        return rows.select(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit("b"), "vector").alias("b"), "id", "vector")

    spark = vectors.sparkSession
    rows = valid(vectors)
    asks = valid(queries) if queries is not None else rows.where(F.pmod("id", F.lit(every)) == 0)
    asks = asks.groupBy("id", "a", "b").agg(F.first("vector").alias("vector"))
    wanted = asks.groupBy("a", "b").agg(F.min("id").alias("id"), F.first("vector").alias("vector"))
    # only vectors that stand in several rows meet
    repeated = written(rows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "repeated")
    few = F.broadcast(repeated) if repeated.count() <= BROADCAST_ROWS else repeated
    several = rows.join(few, ["a", "b"]).groupBy("id", "a", "b").agg(F.first("vector").alias("vector"))
    same = Window.partitionBy("a", "b").orderBy("id")
    several = several.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    base = rows.join(few, ["a", "b"], "left_anti").select("a", "b", "id", "vector").union(several.select("a", "b", "id", "vector"))

    size = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stats = rows.agg(F.count("*").alias("n"), F.max(size).alias("square"), F.avg(F.size("vector")).alias("length")).first()
    square = float(stats.square or 0.0) * (1 + 1e-12)
    most = max(1, min(SAMPLE, int(SAMPLE_BYTES / (8 * max(1.0, stats.length or 1.0)))))
    drawn = F.pmod(F.xxhash64(F.lit("sample"), "id", "a"), F.lit(1 << 30)) < int(min(1.0, most / max(1, stats.n)) * (1 << 30))
    sample: dict[int, np.ndarray] = {}
    for batch in rows.where(drawn).orderBy("id", "a").select("vector").toArrow().to_batches():
        for length, part in _by_length(batch, 0):
            sample[length] = np.vstack([*([sample[length]] if length in sample else []), _vectors(part.column(0))])
    if factor is None:
        factor = min((tuned_factor(s, square, k + 1, target) for s in sample.values()), default=1.0)
    levels = int(np.ceil(np.log2(max(1.0, min(REGIONS, stats.n / shard)))))
    regions = {length: Regions.of(lifted(s, square), levels) for length, s in sample.items() if levels and len(s) >= 4 << levels}

    kind_of = rows.schema["vector"].dataType.simpleString()
    kind = f"a long, b long, id long, vector {kind_of}, length long, region long, far array<double>"
    base = written(base.mapInArrow(tidy(_placed(regions, square, False)), kind), "placed")
    wanted = written(wanted.select("a", "b", "id", "vector").mapInArrow(tidy(_placed(regions, square, True)), kind).drop("id", "far"), "queries")
    bounds = [F.min(F.get("far", F.lit(i))).alias(f"low{i}") for i in range(levels)] + [F.max(F.get("far", F.lit(i))).alias(f"high{i}") for i in range(levels)]
    sizes = written(base.groupBy("length", "region").agg(F.ceil(F.count("*") / shard).alias("shards"), *bounds), "regions")
    for r in sizes.where(F.col("length").isin(list(regions))).collect() if regions else ():
        of = regions[r.length]
        if of.low is None:  # a region without rows is out of every reach
            of.low, of.high = np.full((2**levels, levels), np.inf), np.full((2**levels, levels), -np.inf)
        of.low[r.region], of.high[r.region] = [r[f"low{i}"] for i in range(levels)], [r[f"high{i}"] for i in range(levels)]
    sizes = sizes.select("length", "region", "shards")

    def met(asking: DataFrame) -> DataFrame:
        """What queries (a, b, vector, length, region, floor) find in their regions, each in all its shards."""
        groups = asking.groupBy("length", "region").agg(F.ceil(F.count("*") / QUERIES).alias("groups")).join(sizes, ["length", "region"])
        numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        dealt = lambda key, c: F.pmod(F.xxhash64(*key), F.col(c))
        held = base.join(groups, ["length", "region"]).withColumn("shard", dealt(("id", "a"), "shards")).withColumn("group", numbers("groups"))
        held = held.select("length", "region", "shard", "group", F.lit(False).alias("asks"), "a", "b", "id", "vector", F.lit(0.0).alias("floor"))
        asked = asking.join(groups, ["length", "region"]).withColumn("group", dealt(("a", "b"), "groups")).withColumn("shard", numbers("shards"))
        asked = asked.select("length", "region", "shard", "group", F.lit(True).alias("asks"), "a", "b", F.lit(0).cast("long").alias("id"), "vector", "floor")
        place = F.xxhash64("length", "region", "shard", "group")
        both = held.union(asked).select(place.alias("place"), "asks", "a", "b", "id", "vector", "floor").repartition("place").sortWithinPartitions("place", "asks", "id", "a")
        return best(both.mapInArrow(tidy(_search(k + 1, factor, square)), "a long, b long, vec_id long, mark long, score double"))

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id", "mark")
        return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n")

    found = written(met(wanted.withColumn("floor", F.lit(float("-inf")))), "home")
    if regions:
        floors = found.groupBy("a", "b").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        floor = F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(float("-inf")))
        further = wanted.join(floors, ["a", "b"], "left").select("a", "b", "vector", "length", "region", floor.alias("floor"))
        further = written(further.mapInArrow(tidy(_others(regions, square, factor)), f"a long, b long, vector {kind_of}, length long, region long, floor double"), "further")
        found = best(found.union(met(further)))
    lists = found.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "mark", "score"))).alias("list"))
    own = lambda x: (x["vec_id"] == F.col("id")) & (x["mark"] == F.col("a"))
    told = asks.select("id", "a", "b").join(lists, ["a", "b"]).select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("list", lambda x: ~own(x)), 1, k)).alias("rank", "x"))
    return told.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
