"""Fisher's exact test and the small-sample switch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import div
from ..functions.distributions import z_value
from .hypothesis import proportion_from_counts

C = F.col
CHUNK = 4096
RELATIVE_TIE = 1e-7


def _log_pmf(k: int, total: int, good: int, drawn: int) -> float:
    def log_comb(n: int, r: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)

    return log_comb(good, k) + log_comb(total - good, drawn - k) - log_comb(total, drawn)


def _walk(k: int, step: int, last: int, total: int, good: int, drawn: int):
    """log pmf ratios to the start, chunk by chunk, moving one count at a time."""
    log_ratio = 0.0
    while k != last:
        stop = max(last, k - CHUNK) if step < 0 else min(last, k + CHUNK)
        ks = np.arange(k, stop, step, dtype=float)
        if step > 0:
            r = (good - ks) * (drawn - ks) / ((ks + 1) * (total - good - drawn + ks + 1))
        else:
            r = ks * (total - good - drawn + ks) / ((good - ks + 1) * (drawn - ks + 1))
        logs = log_ratio + np.cumsum(np.log(r))
        yield logs
        log_ratio, k = logs[-1], stop


def fisher_p(cs: int, cn: int, ts: int, tn: int, alternative: str = "two-sided") -> float:
    """Hypergeometric tail of one 2x2 table.

    `greater` asks whether the treatment rate is higher.
    """
    total, good, drawn = cn + tn, cs + ts, tn
    lo, hi = max(0, drawn - (total - good)), min(good, drawn)
    base = _log_pmf(ts, total, good, drawn)

    def tail(step: int, last: int, at_most: float | None) -> float:
        """Sum of pmf/pmf(observed) beyond the observed count."""
        out = 0.0
        for logs in _walk(ts, step, last, total, good, drawn):
            keep = logs if at_most is None else logs[logs <= at_most]
            part = float(np.exp(keep).sum()) if keep.size else 0.0
            out += part
            falling = logs[-1] < logs[0]
            if falling and logs[-1] < math.log(max(out, 1e-300)) - 45 and logs[-1] < -45:
                break
        return out

    if alternative == "greater":
        s = 1.0 + tail(1, hi, None)
    elif alternative == "less":
        s = 1.0 + tail(-1, lo, None)
    else:
        s = 1.0 + tail(1, hi, math.log1p(RELATIVE_TIE)) + tail(-1, lo, math.log1p(RELATIVE_TIE))
    return min(1.0, s * math.exp(base))


def _fisher_udf(alternative: str):
    @F.pandas_udf("double")
    def p_value(cs: pd.Series, cn: pd.Series, ts: pd.Series, tn: pd.Series) -> pd.Series:
        return pd.Series(
            [
                fisher_p(int(a), int(b), int(c), int(d), alternative)
                for a, b, c, d in zip(cs, cn, ts, tn)
            ]
        )

    return p_value


def fishers_exact_test(
    pairs: DataFrame, alpha: float = 0.05, alternative: str = "two-sided"
) -> DataFrame:
    """Exact p on paired counts (`total_*` successes of `n_*`); odds ratio with +0.5.

    The UDF sees one row per cell of the reduced frame.
    """
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"unknown alternative {alternative!r}")
    cs, cn = C("total_control").cast("long"), C("n_control").cast("long")
    ts, tn = C("total_treatment").cast("long"), C("n_treatment").cast("long")
    half = F.lit(0.5)
    log_or = F.log(div((ts + half) * (cn - cs + half), (tn - ts + half) * (cs + half)))
    se = F.sqrt(1 / (ts + half) + 1 / (tn - ts + half) + 1 / (cs + half) + 1 / (cn - cs + half))
    z = F.lit(z_value(1 - alpha / 2))
    zero = F.lit(0).cast("long")
    p = _fisher_udf(alternative)(
        F.coalesce(cs, zero), F.coalesce(cn, zero), F.coalesce(ts, zero), F.coalesce(tn, zero)
    )
    ok = (cn > 0) & (tn > 0)
    return pairs.withColumns(
        {
            "p_value": F.when(ok, p),
            "odds_ratio": F.when(ok, F.exp(log_or)),
            "or_ci_lower": F.when(ok, F.exp(log_or - z * se)),
            "or_ci_upper": F.when(ok, F.exp(log_or + z * se)),
            "error": F.when(~F.coalesce(ok, F.lit(False)), "insufficient_data"),
        }
    ).withColumn("significant", C("p_value") < alpha)


def is_small_sample(n: Column, successes: Column) -> Column:
    return (n < 30) | (successes < 5)


def small_sample_switch(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Both tests of every cell; `test` names the one to report.

    That is the exact test for n < 30 or fewer than 5 successes, else the z
    test; `p_value` is its p, `p_fisher` and `p_proportion` are both.
    """
    small = is_small_sample(C("n_control"), C("total_control")) | is_small_sample(
        C("n_treatment"), C("total_treatment")
    )
    base = pairs.columns
    z = proportion_from_counts(pairs, alpha).select(*base, C("p_value").alias("_pz"))
    both = fishers_exact_test(z, alpha).withColumn("_small", small)
    return both.select(
        *base,
        F.when(C("_small"), "fisher").otherwise("proportion").alias("test"),
        F.when(C("_small"), C("p_value")).otherwise(C("_pz")).alias("p_value"),
        C("p_value").alias("p_fisher"),
        C("_pz").alias("p_proportion"),
    ).withColumn("significant", C("p_value") < alpha)
