"""Centroid clustering of whole-number vectors; nearest centroids by Orchard's search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

CLUSTERS = 16
DIM = 64
SCALE = 64
ROUNDS = 3
SEED = "1"
# Vectors compared with a centroid at once.
BLOCK = 8192
# Below this size of every component, squared distances of DIM components fit a long.
EXACT = 1 << 27
LONG = 2**63 - 1
# Groups in which a cluster's partial sums meet before the driver adds them up.
SALTS = 32


def usable(df: DataFrame, dim: int = DIM) -> DataFrame:
    """``vec_id, embedding (array<double>)`` of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") == dim)).where(finite)


def whole(x: float, scale: int = SCALE) -> int:
    y = x * scale
    return math.floor(y) if math.isfinite(y) else math.floor(x) * scale


def quantized(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Rows x dim of whole numbers: longs, or Python integers where a long is too short."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not (np.abs(y) < EXACT).all():
        return np.array([[whole(v, scale) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    return y.astype(np.int64)


def squares(x: np.ndarray) -> np.ndarray:
    """Squared lengths of rows; Python integers where components are."""
    return (x * x).sum(-1) if x.dtype == object else np.einsum("...i,...i->...", x, x)


@dataclass
class Index:
    """Centroids with each one's list of neighbours, nearest first."""

    centroids: np.ndarray
    order: np.ndarray
    apart: np.ndarray

    @staticmethod
    def of(centroids: list[list[int]]) -> Index:
        c = np.array(centroids, dtype=object).reshape(len(centroids), -1)
        apart = [squares(c - row) for row in c]
        order = np.array([sorted(range(len(c)), key=lambda j: (row[j], j)) for row in apart], np.int64)
        small = all(abs(v) < EXACT for row in centroids for v in row)
        far = np.array([[row[j] for j in own] for row, own in zip(apart, order)], dtype=object)
        return Index(c.astype(np.int64), order, far.astype(np.int64)) if small else Index(c, order, far)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each row's nearest centroid (of equals the smallest), and comparisons made.

        Every row walks the list of its best centroid so far.  A closer one, or
        an equal one of smaller number, makes it jump to that one's list from the
        start; visited centroids are not compared again.  The walk ends where the
        list's next neighbour is strictly further from the best centroid than
        twice the row is: from there on all are strictly further from the row.
        """
        if self.centroids.dtype == object or x.dtype == object:
            x, centroids, apart = x.astype(object), self.centroids.astype(object), self.apart.astype(object)
        else:
            centroids, apart = self.centroids, self.apart
        k, n = len(centroids), len(x)
        best = np.zeros(n, np.int64)
        near = squares(x - centroids[0])
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        at = np.zeros(n, np.int64)
        alive, compared = np.arange(n), n
        while len(alive):
            own = best[alive]
            go = (apart[own, at[alive]] <= 4 * near[alive]).astype(bool)
            alive = alive[go]
            own = own[go]
            other = self.order[own, at[alive]]
            at[alive] += 1
            fresh = ~seen[alive, other]
            rows, other = alive[fresh], other[fresh]
            seen[rows, other] = True
            compared += len(rows)
            d = squares(x[rows] - centroids[other])
            closer = ((d < near[rows]) | ((d == near[rows]) & (other < best[rows]))).astype(bool)
            rows, other = rows[closer], other[closer]
            best[rows], near[rows], at[rows] = other, d[closer], 0
            alive = alive[at[alive] < k]
        return best, near, compared


def first_centroids(vectors: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of seed and id, in that order; equal ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    return [[whole(v, scale) for v in r.embedding] for r in rows]


PARTIAL = "cluster int, salt int, count long, sums array<string>"


def _partial(index: Index, dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(index.centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), object)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = quantized(batch.column("embedding").slice(at, BLOCK), dim, scale)
                best = index.nearest(x)[0]
                for c in np.unique(best).tolist():
                    own = x[best == c]
                    counts[c] += len(own)
                    sums[c] += own.sum(0).astype(object)
        used = np.flatnonzero(counts)
        salt = TaskContext.get().partitionId() % SALTS
        text = [[str(v) for v in sums[c]] for c in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([salt] * len(used), pa.int32()), pa.array(counts[used]), pa.array(text, pa.list_(pa.string()))],
            ["cluster", "salt", "count", "sums"],
        )

    return run


def _added(part: pa.Table) -> pa.Table:
    total = [sum(map(int, column)) for column in zip(*part.column("sums").to_pylist())]
    return pa.table({
        "cluster": part.column("cluster").slice(0, 1), "salt": part.column("salt").slice(0, 1),
        "count": pa.array([sum(part.column("count").to_pylist())], pa.int64()),
        "sums": pa.array([[str(v) for v in total]], pa.list_(pa.string())),
    })


def moved(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """Each centroid replaced by the floored mean of its vectors; one without vectors stays.

    A task gives one row of exact sums a cluster, and ``SALTS`` rows a cluster at
    most reach the driver, whatever the number of vectors.
    """
    index = Index.of(centroids)
    partial = vectors.mapInArrow(_partial(index, len(centroids[0]), scale), PARTIAL)
    added = partial.groupBy("cluster", "salt").applyInArrow(_added, PARTIAL).collect()
    out = [list(c) for c in centroids]
    for cluster in {r.cluster for r in added}:
        own = [r for r in added if r.cluster == cluster]
        count = sum(r["count"] for r in own)
        out[cluster] = [sum(map(int, column)) // count for column in zip(*(r.sums for r in own))]
    return out


def _assign(index: Index, dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, near = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows, np.int64)
            for at in range(0, batch.num_rows, BLOCK):
                x = quantized(batch.column("embedding").slice(at, BLOCK), dim, scale)
                best[at : at + BLOCK], d, _ = index.nearest(x)
                near[at : at + BLOCK] = [min(v, LONG) for v in d.tolist()] if d.dtype == object else d
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(best), pa.array(near)], ["vec_id", "cluster", "distance"]
            )

    return run


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def fit(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> list[list[int]]:
    """The centroids after ``rounds``; none if no vector takes part, fewer than ``k`` if fewer take part."""
    vectors = usable(df, dim)
    centroids = first_centroids(vectors, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = moved(vectors, centroids, scale)
    return centroids


def assign(df: DataFrame, centroids: list[list[int]], dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector that takes part."""
    rows = usable(df, dim)
    if not centroids:
        return rows.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    return rows.mapInArrow(_assign(Index.of(centroids), dim, scale), "vec_id long, cluster int, distance long")


def cluster(df: DataFrame, **options) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for every vector that takes part.

    Vectors that are null, of another length, or hold a null or non-finite
    component take no part.  Every row is a vector of its own, also where ids
    repeat or are null (a null id is hashed as empty text); of rows with one id
    the smaller vector comes first among the first centroids.  A distance or sum
    beyond the range of long stays at its end; sums behind centroids are exact
    at any size.  Columns besides ``vec_id`` and ``embedding`` play no part.  An
    empty table gives no rows.
    """
    centroids = fit(df, **options)
    shape = {key: options[key] for key in ("dim", "scale") if key in options}
    found = assign(df, centroids, **shape)
    # A row a cluster: the bound is k.
    total = "decimal(38,0)"
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast(total)).alias("s")).collect()}
    rows = [(i, min(sums.get(i, 0), LONG), centroid_digest(c)) for i, c in enumerate(centroids)]
    known = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")
    known = known.withColumn("inertia", F.lit(min(sum(sums.values()), LONG)).cast("long"))
    joined = found.join(F.broadcast(known), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
