"""Exact top-k inner products by columnar branch-and-bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .vectors import answer, clean_vectors, matrix, search_tiles
from .common import store

SCALE = 1024
BLOCK_DIMS = 8
LONG = 2**63


def quantized(df: DataFrame) -> DataFrame:
    """Vectors with each component x as floor(1024 * x), a double holding a whole number."""
    return clean_vectors(df).withColumn(
        "embedding", F.transform("embedding", _floor)
    )


def _floor(x):
    # floor() of a double gives a long and so clips huge values; doubles from 2^53 on are whole already.
    y = x * F.lit(float(SCALE))
    return F.when(F.abs(y) < float(2**53), F.floor(y).cast("double")).otherwise(y)


def best_rows(columns: list[np.ndarray], tails: np.ndarray, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of the ``k`` best rows and all that tie with the last.

    ``columns`` holds the rows' components in vertical blocks (block dims x
    rows), ``tails[b]`` each row's norm over the blocks from b on.  Scores grow
    block by block; what is left of a row can add or take at most the product of
    both tails (Cauchy-Schwarz).  Rows that cannot reach the k-th best floor go,
    and the arrays are compacted.
    """
    n = tails.shape[1]
    alive = np.arange(n)
    alive = alive[alive != own]
    score = np.zeros(len(alive))
    left = np.array([np.sqrt((query[b * BLOCK_DIMS :] ** 2).sum()) for b in range(len(columns) + 1)])
    for b, block in enumerate(columns):
        part = query[b * BLOCK_DIMS : (b + 1) * BLOCK_DIMS]
        score = score + part @ (block if len(alive) == n else block[:, alive])
        if len(alive) > k:
            spare = left[b + 1] * tails[b + 1][alive]
            spare = spare * (1 + 1e-9) + 1e-9 * np.abs(score) + 1e-6
            floor = np.partition(score - spare, len(alive) - k)[len(alive) - k]
            stay = score + spare >= floor
            if not stay.all():
                alive, score = alive[stay], score[stay]
    return alive, score


def beyond_long(total: int) -> bytes | None:
    """A key that orders exact scores at the ends of long; null where the score itself does."""
    return None if -LONG < total < LONG - 1 else (total + (1 << 2100)).to_bytes(264, "big")


def _search(k: int):
    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return answer([], [], [], pa.int64())
        dim = rows.column("dim")[0].as_py()
        ids = rows.column("vec_id").to_numpy()
        x = matrix(rows.column("embedding"), dim)
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        starts = range(0, dim, BLOCK_DIMS)
        columns = [np.ascontiguousarray(x[:, at : at + BLOCK_DIMS].T) for at in starts]
        # Sums below 2^53 are exact in doubles; beyond, the few survivors are summed as whole numbers.
        squares = np.array([(c**2).sum(0) for c in columns]).reshape(len(columns), len(x))
        tails = np.zeros((len(columns) + 1, len(x)))
        if len(columns):
            tails[:-1] = np.sqrt(np.cumsum(squares[::-1], 0)[::-1])
        most = float(np.abs(x).max(initial=0))
        out, beyond = ([], [], []), []
        qids, qs = queries.column("vec_id").to_numpy(), matrix(queries.column("embedding"), dim)
        for qid, q in zip(qids, qs):
            at = np.searchsorted(ids, qid)
            own = int(at) if at < len(ids) and ids[at] == qid else -1
            alive, score = best_rows(columns, tails, q, k, own)
            if dim * most * float(np.abs(q).max(initial=0)) < 2**53:
                score = score.astype(np.int64)
                best = np.lexsort((ids[alive], -score))[:k]
                beyond.append([None] * len(best))
            else:
                whole = [int(v) for v in q.tolist()]
                sums = [sum(a * int(b) for a, b in zip(whole, x[i].tolist())) for i in alive.tolist()]
                best = sorted(range(len(sums)), key=lambda i: (-sums[i], ids[alive[i]]))[:k]
                beyond.append([beyond_long(sums[i]) for i in best])
                score = np.array([min(max(s, -LONG), LONG - 1) for s in sums], np.int64)
            out[0].append(np.full(len(best), qid))
            out[1].append(ids[alive][best])
            out[2].append(score[best])
        return answer(*out, pa.int64(), [key for part in beyond for key in part])

    return search


def top_k(df: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` largest integer inner products.

    Queries are the ids divisible by ``every``, candidates all other rows of the
    same length; ties go to the smaller id.  See ``clean_vectors`` for rows that
    take no part and for repeated ids.  A score beyond the range of long stays
    at its end, in the order of the exact scores.  Empty vectors meet each other with score 0; an empty table
    gives no rows.
    """
    return search_tiles(store(quantized(df), "quantized"), every, k, _search(k), "long")
