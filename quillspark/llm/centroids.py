"""Centroid clustering of integer vectors with Hamerly's bounds, exactly.

Vectors are turned into integers once.  Every vector keeps, from round to round
in a staged table, its cluster, one upper bound of the distance to its own
centroid and one lower bound of the distance to the second nearest.  After the
centroids moved, the upper bound grows by the own centroid's drift and the lower
one falls by the largest drift of the others.  A vector whose upper bound stays
under the lower one, or under half the way from its centroid to the nearest
other, keeps its cluster unread; else the upper bound is made exact, and only if
that doesn't decide it all centroids are scanned, in integers.  Bounds are
widened outward by more than floating point can be off, and compared strictly, so
clusters are those of a full scan, ties included.

Sums of a cluster change only by the vectors that moved; they are integers and
added map-side.  What the driver holds are the centroids and one row of sums for
each: bounded by ``k`` and ``dims`` alone.

Null vectors, vectors of another length and those with null or non-finite
components take no part.  Rows of a repeated vec_id are vectors of their own;
vectors with a null vec_id are clustered but never first centroids.  Of equal
hashes the smaller vector comes first.  Fewer vectors than ``k`` make fewer
centroids; an empty table gives no rows.  Components beyond ``MOST`` in size end
the job with an error, as distances wouldn't fit a long.  Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stage, unstage

#: Largest component, after scaling, whose squared distances fit a long.
MOST = 1 << 26
#: Rows of a block while all centroids are scanned.
BLOCK = 4096
#: Bounds are widened by this much at every step.
SLACK = 1e-12


def integer_vectors(table: DataFrame, dims: int, scale: int, column: str = "embedding") -> DataFrame:
    """vec_id and v, the vector of floor(scale * x), of the vectors that count."""
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    scaled = F.transform(column, lambda x: F.lit(float(scale)) * x.cast("double"))
    rows = table.where((F.size(column) == dims) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))
    large = F.exists("x", lambda x: F.abs(x) > F.lit(float(MOST)))
    said = F.raise_error(F.concat(F.lit("component too large in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))
    return rows.select("vec_id", F.when(large, said).otherwise(F.transform("x", lambda x: F.floor(x).cast("int"))).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of the least hashes of ``<seed>:<vec_id>``, in their order."""
    hashed = vectors.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    return np.array([r.v for r in hashed.orderBy("hash", "v").limit(k).collect()], np.int64)  # k rows


def _distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to every centroid, in integers."""
    return (v * v).sum(1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(1)[None, :]


class Bounds:
    """What a round needs to know of the centroids and of their last move."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        self.centroids = centroids
        k = len(centroids)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
        self.drift = moved
        order = np.argsort(-moved, kind="stable")
        #: the largest drift among the other centroids
        self.others = np.full(k, moved[order[0]])
        self.others[order[0]] = moved[order[1]] if k > 1 else 0.0
        apart = np.sqrt(_distances(centroids, centroids).astype(np.float64))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 * (1 - SLACK)

    def scan(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties: smaller number) and both bounds."""
        cluster, upper, lower = (np.empty(len(v), t) for t in (np.int32, np.float64, np.float64))
        for at in range(0, len(v), BLOCK):
            d = _distances(v[at: at + BLOCK], self.centroids)
            rows, own = np.arange(len(d)), d.argmin(1)
            cluster[at: at + BLOCK] = own
            upper[at: at + BLOCK] = np.sqrt(d[rows, own]) * (1 + SLACK)
            second = np.partition(d, 1, axis=1)[:, 1] if d.shape[1] > 1 else np.full(len(d), np.inf)
            lower[at: at + BLOCK] = np.sqrt(second) * (1 - SLACK)
        return cluster, upper, lower

    def own_distance(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((v - self.centroids[cluster]) ** 2).sum(1)

    def advance(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Clusters and bounds after the centroids moved."""
        cluster = cluster.copy()
        upper = (upper + self.drift[cluster]) * (1 + SLACK)
        lower = np.maximum(lower - self.others[cluster] * (1 + SLACK), 0.0) * (1 - SLACK)
        safe = np.maximum(self.half[cluster], lower)
        open_ = np.flatnonzero(upper >= safe)
        upper[open_] = np.sqrt(self.own_distance(v[open_], cluster[open_])) * (1 + SLACK)
        open_ = open_[upper[open_] >= safe[open_]]
        cluster[open_], upper[open_], lower[open_] = self.scan(v[open_])
        return cluster, upper, lower


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


STATE = "vec_id long, v array<int>, cluster int, was int, upper double, lower double"


def _assigned(rows: DataFrame, bounds: Bounds, dims: int) -> DataFrame:
    """The state after a round; ``rows`` are vectors alone in the first."""
    shipped = rows.sparkSession.sparkContext.broadcast(bounds)  # k centroids
    begun = "cluster" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            if begun:
                was = batch.column("cluster").to_numpy()
                cluster, upper, lower = shipped.value.advance(v, was, batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            else:
                was = np.full(len(v), -1, np.int32)
                cluster, upper, lower = shipped.value.scan(v)
            columns = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cluster", "was", "upper", "lower"])

    return rows.mapInArrow(run, STATE)


def _measured(state: DataFrame, bounds: Bounds, dims: int) -> DataFrame:
    """vec_id, cluster and the exact squared distance of the last assignment."""
    shipped = state.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), dims)
            cluster, _, _ = shipped.value.advance(v, batch.column("cluster").to_numpy(), batch.column("upper").to_numpy(), batch.column("lower").to_numpy())
            distance = shipped.value.own_distance(v, cluster)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long")


def _add_moves(state: DataFrame, sums: np.ndarray, counts: np.ndarray) -> None:
    """Bring the clusters' sums and counts up to date by the vectors that moved."""
    dims = sums.shape[1]
    moved = state.where("cluster <> was")
    for side, sign in (("cluster", 1), ("was", -1)):
        totals = moved.where(F.col(side) >= 0).groupBy(side).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(dims)]).alias("sums"))
        for r in totals.collect():  # k rows
            sums[r[side]] += sign * np.array(r.sums, np.int64)
            counts[r[side]] += sign * r.n


def cluster(table: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance (squared) of every vector after ``rounds``
    rounds, and the final centroids."""
    vectors = stage(integer_vectors(table, dims, scale, column), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        if not vectors.isEmpty():  # ids are all null: the first by value
            centroids = np.array([r.v for r in vectors.orderBy("v").limit(1).collect()], np.int64)
        else:
            unstage(vectors)
            return table.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dims), np.int64)
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    state, before = vectors, None
    for _ in range(rounds):
        last = state
        state = stage(_assigned(last, Bounds(centroids, before), dims), "bounds")
        unstage(last)
        _add_moves(state, sums, counts)
        before = centroids
        centroids = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
    if not rounds:
        state = stage(_assigned(vectors, Bounds(centroids, None), dims), "bounds")
        unstage(vectors)
    found = stage(_measured(state, Bounds(centroids, before), dims), "clusters")
    unstage(state)
    return found, centroids


def digests(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The clusters with their and the total inertia and the centroids' hashes."""
    totals = found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()  # k rows
    every = sum(r.inertia for r in totals)
    hashed = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    rows = [(r.cluster, r.inertia, every, hashed[r.cluster]) for r in totals]
    known = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
