"""Sequential tests that stay valid under continuous looking."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import MSPRT_MIN_N, RATE_VARIANCE_FLOOR, VARIANCE_FLOOR
from ..functions.columns import div, num
from ..functions.distributions import norm_ppf, norm_sf, z_value
from .moments import pair_arms

C = F.col
INF = float("inf")


def _mixture(df: DataFrame, sigma2: Column, tau: float | None, alpha: float) -> DataFrame:
    """Gaussian-mixture radius and e-value from diff, n and a variance column."""
    step = df.withColumns(
        {
            "_s2": sigma2,
            "_n": div(C("n_control") * C("n_treatment").cast("double"), C("n_control") + C("n_treatment")),
        }
    )
    step = step.withColumn("_t2", F.lit(tau * tau) if tau is not None else C("_s2"))
    step = step.withColumn("_den", C("_s2") + C("_n") * C("_t2"))
    step = step.withColumn("_log", F.log(F.sqrt(div(C("_den"), C("_s2"))) / F.lit(alpha)))
    flat = C("_log") <= 0
    radius = F.sqrt(div(2 * C("_s2") * C("_den"), C("_n") * C("_n") * C("_t2")) * C("_log"))
    exponent = div(C("_n") * C("_n") * C("diff") * C("diff") * C("_t2"), 2 * C("_s2") * C("_den"))
    log_e = exponent + 0.5 * F.log(div(C("_s2"), C("_den")))
    step = step.withColumns(
        {
            "radius": F.when(flat, F.lit(INF)).otherwise(radius),
            "e_value": F.when(flat, F.lit(1.0)).when(log_e > 709.0, F.lit(INF)).otherwise(F.exp(log_e)),
            "tau": F.sqrt(C("_t2")),
        }
    )
    return step.withColumns(
        {"av_ci_lower": C("diff") - C("radius"), "av_ci_upper": C("diff") + C("radius")}
    ).drop("_s2", "_n", "_t2", "_den", "_log")


def always_valid_ci(pairs: DataFrame, alpha: float = 0.05, tau: float | None = None) -> DataFrame:
    """Always-valid interval of the mean difference from paired moments."""
    nc, nt = C("n_control"), C("n_treatment")
    enough = (nc >= 2) & (nt >= 2)
    pooled = div((nc - 1) * C("var_control") + (nt - 1) * C("var_treatment"), nc + nt - 2)
    sigma2 = F.when(enough, F.greatest(pooled, F.lit(VARIANCE_FLOOR)))
    return _mixture(
        pairs.withColumn("diff", C("mean_treatment") - C("mean_control")), sigma2, tau, alpha
    )


def _excludes_zero() -> Column:
    return (C("av_ci_lower") > 0) | (C("av_ci_upper") < 0)


def msprt_test(
    pairs: DataFrame, alpha: float = 0.05, tau: float | None = None, min_n: int = MSPRT_MIN_N
) -> DataFrame:
    """Mixture sequential probability ratio test; stops only past `min_n` per arm."""
    out = always_valid_ci(pairs, alpha, tau)
    ready = (C("n_control") >= min_n) & (C("n_treatment") >= min_n)
    return out.withColumns(
        {
            "excludes_zero": _excludes_zero(),
            "decision": F.when(_excludes_zero() & ready, "STOP_REJECT").otherwise("CONTINUE"),
            "error": F.when((C("n_control") < 2) | (C("n_treatment") < 2), "insufficient_data"),
        }
    )


def sequential_proportion_test(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The same on a difference of rates, with plug-in variance and no floor on n."""
    rc, rt = div(C("total_control"), C("n_control")), div(C("total_treatment"), C("n_treatment"))
    step = pairs.withColumns({"rate_control": rc, "rate_treatment": rt}).withColumn("diff", rt - rc)
    rc, rt = C("rate_control"), C("rate_treatment")
    sigma2 = F.greatest((rc * (1 - rc) + rt * (1 - rt)) / 2, F.lit(RATE_VARIANCE_FLOOR))
    out = _mixture(step, sigma2, None, alpha)
    return out.withColumn("decision", F.when(_excludes_zero(), "STOP_REJECT").otherwise("CONTINUE"))


def cumulative_sufficient_stats(
    df: DataFrame,
    keys: Sequence[str],
    look: str,
    value: str = "value",
    arm: str = "arm",
) -> DataFrame:
    """Running n, mean, variance and total per arm at every look.

    Rows reduce to one partial per look first.  Sums are centred on the arm's
    mean before they run, which avoids the cancellation of raw squares.
    """
    v = num(value)
    daily = (
        df.where(C(arm).isNotNull())
        .groupBy(*keys, look, arm)
        .agg(
            F.count(v).alias("_n"),
            F.coalesce(F.avg(v), F.lit(0.0)).alias("_m"),
            F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("_m2"),
        )
    )
    arm_all = Window.partitionBy(*keys, arm)
    running = arm_all.orderBy(look).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    centre = div(F.sum(C("_n") * C("_m")).over(arm_all), F.sum("_n").over(arm_all))
    shifted = daily.withColumn("_c", F.coalesce(centre, F.lit(0.0)))
    d = C("_m") - C("_c")
    shifted = shifted.withColumns(
        {
            "n": F.sum("_n").over(running),
            "_s1": F.sum(C("_n") * d).over(running),
            "_s2": F.sum(C("_m2") + C("_n") * d * d).over(running),
        }
    )
    mean_shift = div(C("_s1"), C("n"))
    return shifted.select(
        *keys,
        look,
        arm,
        "n",
        (C("_c") + mean_shift).alias("mean"),
        F.when(
            C("n") > 1, F.greatest(F.lit(0.0), div(C("_s2") - C("_s1") * mean_shift, C("n") - 1))
        ).alias("var"),
        (C("_c") * C("n") + C("_s1")).alias("total"),
    )


def complete_looks(stats: DataFrame, keys: Sequence[str], look: str, arm: str = "arm") -> DataFrame:
    """Carry each arm's last totals to looks in which it received nothing."""
    looks = stats.select(*keys, look).distinct()
    arms = stats.select(*keys, arm).distinct()
    grid = looks.join(arms, list(keys)).join(stats, [*keys, look, arm], "left")
    back = Window.partitionBy(*keys, arm).orderBy(look).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    carried = {c: F.last(c, ignorenulls=True).over(back) for c in ("n", "mean", "var", "total")}
    return grid.withColumns(carried).where(C("n").isNotNull())


def sequential_path(
    df: DataFrame,
    keys: Sequence[str],
    look: str,
    value: str = "value",
    arm: str = "arm",
    control: str = "control",
    alpha: float = 0.05,
    min_n: int = MSPRT_MIN_N,
) -> DataFrame:
    """The always-valid interval at every look, and the first look that stops."""
    stats = complete_looks(cumulative_sufficient_stats(df, keys, look, value, arm), keys, look, arm)
    paired = pair_arms(stats, [*keys, look], arm, control).where(C("n_control").isNotNull())
    path = msprt_test(paired, alpha, None, min_n)
    cell = Window.partitionBy(*keys, arm)
    return path.withColumns(
        {
            "look_no": F.row_number().over(cell.orderBy(look)),
            "first_stop": F.min(F.when(C("decision") == "STOP_REJECT", C(look))).over(cell),
        }
    )


def spent_alpha(t: Column, alpha: float, spending: str) -> Column:
    if spending == "obrien_fleming":
        return 2 * norm_sf(F.lit(z_value(1 - alpha / 2)) / F.sqrt(t))
    if spending == "pocock":
        return F.lit(alpha) * F.log(1 + F.lit(math.e - 1) * t)
    raise ValueError(f"unknown spending function {spending!r}")


def group_sequential_boundaries(
    df: DataFrame, look_no: str, n_looks: str, alpha: float = 0.05, spending: str = "obrien_fleming"
) -> DataFrame:
    """Cumulative alpha, its increment and the z boundary of each look.

    Increments ignore the correlation between looks; this is the documented
    approximation, conservative for later looks.
    """
    k, total = C(look_no).cast("double"), C(n_looks).cast("double")
    now, before = div(k, total), div(k - 1, total)
    step = df.withColumn("cumulative_alpha", spent_alpha(now, alpha, spending))
    prior = F.when(k > 1, spent_alpha(F.greatest(before, F.lit(1e-9)), alpha, spending)).otherwise(0.0)
    step = step.withColumn(
        "incremental_alpha", F.greatest(C("cumulative_alpha") - prior, F.lit(1e-12))
    )
    return step.withColumns(
        {
            "information_fraction": now,
            "z_boundary": norm_ppf(1 - C("incremental_alpha") / 2),
        }
    )
