"""Approximate nearest neighbours by a permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import store
from .vectors import answer, clean_vectors, matrix, search_tiles

# The pivots of each vector length are a bounded sample; every row is indexed by its nearest ones.
PIVOTS = 512
NEAREST = 32
# Pivots of all lengths together, and the fewest that order a length's rows: a
# length with fewer is compared whole, which is exact.
ALL_PIVOTS = 8192
FEWEST = 128
# The share of a shard's rows, nearest by footrule, whose vectors are compared.
RERANK_SHARE = 0.25


def _indexer(pivots: dict[int, np.ndarray], longest: dict[int, float]):
    def lifted(x: np.ndarray, dim: int) -> np.ndarray:
        # In units of the longest vector, so that no square overflows.  One more
        # component gives all vectors the same length, so the largest inner
        # product with a query is the smallest angle.
        half = np.exp(-longest[dim] / 2)
        x = x * half * half
        return np.concatenate([x, np.sqrt(np.maximum(1 - (x**2).sum(1), 0))[:, None]], 1)

    by_dim = {dim: lifted(x, dim) for dim, x in pivots.items()}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, orders = pa.Table.from_batches([batch]), [None] * batch.num_rows
            dims = rows.column("dim").to_numpy()
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                if dim not in by_dim:
                    continue
                x = lifted(matrix(rows.column("embedding").take(pa.array(at)), dim), dim)
                near = -(x @ by_dim[dim].T)
                order = np.argsort(near, axis=1, kind="stable")[:, :NEAREST]
                for i, o in zip(at.tolist(), order.astype(np.int16)):
                    orders[i] = o
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[] if o is None else o for o in orders], pa.list_(pa.int16()))],
                ["vec_id", "dim", "embedding", "pivots"],
            )

    return index


def permutations(rows: DataFrame) -> DataFrame:
    """Adds ``pivots``: the numbers of each vector's nearest pivots, nearest first.

    Up to ``PIVOTS`` rows of each length, taken by hash of their id, are its
    pivots.  A length with fewer than ``FEWEST`` (few rows, or so many lengths
    that ``ALL_PIVOTS`` is used up) has empty lists, and its rows are all compared.
    """
    hashed = rows.select("dim", "embedding", "vec_id", F.xxhash64("vec_id").alias("_h"))
    by_hash = Window.partitionBy("dim").orderBy("_h", "vec_id")
    first = hashed.withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= PIVOTS)
    taken: dict[int, list] = {}
    for r in first.orderBy("_n", "_h", "vec_id").limit(ALL_PIVOTS).collect():
        taken.setdefault(r.dim, []).append(r.embedding)
    pivots = {dim: np.array(x) for dim, x in taken.items() if len(x) >= FEWEST}
    # The logarithm of the longest vector's length; where squares overflow or vanish, an upper bound of it.
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    bound = F.log(F.array_max(F.transform("embedding", F.abs))) + F.log("dim") / 2
    measured = rows.where(F.col("dim").isin(list(pivots))).select("dim", squares.alias("_s"), bound.alias("_b"))
    length = F.when((F.col("_s") > 0) & (F.col("_s") < float("inf")), F.log("_s") / 2).otherwise(F.col("_b"))
    lengths = measured.groupBy("dim").agg(F.max(length).alias("longest"))
    longest = {r.dim: r.longest for r in lengths.collect()} if pivots else {}
    return rows.mapInArrow(_indexer(pivots, longest), "vec_id long, dim int, embedding array<double>, pivots array<short>")


def _search(k: int, share: float):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return answer([], [], [], pa.float64())
        rows = rows.sort_by("vec_id")
        dim, n = rows.column("dim")[0].as_py(), rows.num_rows
        ids, x = rows.column("vec_id").to_numpy(), matrix(rows.column("embedding"), dim)
        length = len(rows.column("pivots")[0])
        seen = matrix(rows.column("pivots"), length).ravel()
        # Inverted files: for each pivot, the rows that list it and its place in their lists.
        order = np.argsort(seen, kind="stable")
        ends = np.searchsorted(seen[order], np.arange(PIVOTS + 1))
        posted, place = order // max(length, 1), (length - order % max(length, 1)).astype(np.int64)
        take = min(n, max(k + 1, int(np.ceil(share * n)))) if length else n
        tie = np.arange(n, 0, -1)
        out = ([], [], [])
        asked = matrix(queries.column("pivots"), length)
        for qid, q, near in zip(queries.column("vec_id").to_numpy(), matrix(queries.column("embedding"), dim), asked):
            # Footrule with absent pivots placed after the last: length * (length + 1)
            # less twice the shared pivots' smaller distance from that place.
            shared = np.zeros(n, np.int64)
            for i, p in enumerate(near.tolist()):
                part = slice(ends[p], ends[p + 1])
                shared[posted[part]] += np.minimum(place[part], length - i)
            rank = shared * (n + 1) + tie  # ties to the smaller id
            near_rows = np.argpartition(rank, n - take)[n - take :] if take < n else np.arange(n)
            near_rows = near_rows[ids[near_rows] != qid]
            score = (x[near_rows] * q).sum(1)
            best = np.lexsort((ids[near_rows], -score))[:k]
            out[0].append(np.full(len(best), qid))
            out[1].append(ids[near_rows][best])
            out[2].append(score[best])
        return answer(*out, pa.float64())

    return search


def nearest(df: DataFrame, k: int = 20, every: int = 20, share: float = RERANK_SHARE) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the ``k`` largest inner products of each query.

    Queries are the ids divisible by ``every``; candidates are all other rows of
    the same length.  Every row is indexed; in each shard the ``share`` of rows
    nearest by footrule is compared on the original vectors in doubles, ties to
    the smaller id.  Zero vectors take no part; see ``clean_vectors`` for other
    rows that do not and for repeated ids.  An empty table gives no rows.
    """
    rows = clean_vectors(df).where(F.exists("embedding", lambda x: x != 0))
    return search_tiles(store(permutations(store(rows, "vectors")), "permutations"), every, k, _search(k, share), "double")
