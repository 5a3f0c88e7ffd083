"""Group-sequential boundaries that account for the correlation between looks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

GRID = 801
LARGEST_Z = 40.0
LEAST_SPENT = 1e-12

_upper_tail = np.vectorize(lambda x: 0.5 * math.erfc(x / math.sqrt(2)), otypes=[float])


def _spent(t: float, alpha: float, spending: str) -> float:
    if spending == "pocock":
        return alpha * math.log(1 + (math.e - 1) * t)
    return math.erfc(NormalDist().inv_cdf(1 - alpha / 2) / math.sqrt(2 * t))


def boundaries(
    n_looks: int, alpha: float = 0.05, spending: str = "obrien_fleming", each_side: bool = False
) -> list[float]:
    """The two-sided z boundary of each equally spaced look.

    The density of the score among paths that have not stopped is carried from
    look to look by Simpson sums over its increment; each boundary is where the
    probability of a first crossing equals the error spent at that look.  With
    ``each_side`` both sides spend half of alpha by a function of their own, as
    in published tables; without it one function spends the whole, as in
    ``sequential.spent_alpha``.
    """
    if spending not in ("obrien_fleming", "pocock"):
        raise ValueError(f"unknown spending function {spending!r}")
    sd = math.sqrt(1 / n_looks)
    points, mass, before, found = np.zeros(1), np.ones(1), 0.0, []
    for k in range(1, n_looks + 1):
        t = k / n_looks
        now = 2 * _spent(t, alpha / 2, spending) if each_side else _spent(t, alpha, spending)
        step, before = max(now - before, LEAST_SPENT), now
        low, high = 0.0, LARGEST_Z
        for _ in range(60):
            z = (low + high) / 2
            b = z * math.sqrt(t)
            crossing = float(mass @ (_upper_tail((b - points) / sd) + _upper_tail((b + points) / sd)))
            low, high = (z, high) if crossing > step else (low, z)
        found.append(high)
        b = min(high, 8.0) * math.sqrt(t)  # beyond eight deviations there is no mass to carry
        grid = np.linspace(-b, b, GRID)
        weights = np.where(np.arange(GRID) % 2 == 1, 4.0, 2.0) * (grid[1] - grid[0]) / 3
        weights[[0, -1]] /= 2
        kernel = np.exp(-0.5 * ((grid[:, None] - points[None, :]) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))
        points, mass = grid, (kernel @ mass) * weights
    return found


def correlated_boundaries(
    df: DataFrame,
    look_no: str,
    n_looks: str,
    alpha: float = 0.05,
    spending: str = "obrien_fleming",
    each_side: bool = False,
) -> DataFrame:
    """``df`` with ``z_correlated``, the boundary of its look; null where look or count is null or out of range.

    The table of boundaries has one computation for each different count of looks.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n in frame["_n"]:
                z = boundaries(int(n), alpha, spending, each_side)
                yield pd.DataFrame({"_n": int(n), "_k": range(1, int(n) + 1), "z_correlated": z})

    counts = df.select(F.col(n_looks).cast("long").alias("_n")).where("_n >= 1").distinct()
    table = counts.mapInPandas(rows, "_n long, _k long, z_correlated double")
    on = (F.col(n_looks).cast("long") == F.col("_n")) & (F.col(look_no).cast("long") == F.col("_k"))
    return df.join(table, on, "left").drop("_n", "_k")
