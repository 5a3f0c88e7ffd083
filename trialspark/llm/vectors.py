"""Vector tables and the tiling of a query set against all rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

# Rows and queries of a tile.  They bound a task's memory; results do not depend on them.
TILE_ROWS = 16384
TILE_QUERIES = 2048


def clean_vectors(df: DataFrame) -> DataFrame:
    """``vec_id, dim, embedding (array<double>)`` of the rows that take part.

    Rows drop out whose id or vector is null or that hold a null or non-finite
    component.  Repeated ids count once (the smallest vector stands for the id).
    """
    whole = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return rows.select("vec_id", F.size("embedding").alias("dim"), "embedding")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A list column as rows x dim."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def search_tiles(
    rows: DataFrame, every: int, k: int, search: Callable[[pa.Table, pa.Table], pa.Table], score: str
) -> DataFrame:
    """Best ``k`` rows for each row of ``rows`` (stored) whose id is divisible by ``every``.

    Rows are dealt to shards and queries to blocks, and ``search(rows, queries)``
    runs on each (block, shard) pair of one dimension, giving ``query_id, vec_id,
    score, beyond``: at most ``k`` a query.  A window merges the shards' answers;
    ``beyond`` orders equal scores where the kind of number ends (null sorts
    last).  Only vectors of the same length meet.
    """
    asked = rows.where(F.col("vec_id") % every == 0)
    shards = max(1, math.ceil(rows.count() / TILE_ROWS))
    blocks = max(1, math.ceil(asked.count() / TILE_QUERIES))
    dealt = F.xxhash64("vec_id")
    left = rows.withColumn("shard", F.pmod(dealt, F.lit(shards)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = asked.withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    keys = ["dim", "block", "shard"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        search, f"query_id long, vec_id long, score {score}, beyond binary"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def answer(query_ids: list, vec_ids: list, scores: list, kind: pa.DataType, beyond: list | None = None) -> pa.Table:
    """The parts a tile found, as one table."""
    names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), kind]
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (query_ids, vec_ids, scores)]
    columns = [pa.array(x, type=t) for x, t in zip(flat, kinds)]
    columns.append(pa.array(beyond or [None] * len(flat[0]), pa.binary()))
    return pa.table(columns, names=[*names, "beyond"])
