"""Covariate adjustment from joint moments: one scan, no second pass over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import div, num
from ..session import small_side
from .hypothesis import welch_from_moments
from .moments import pair_arms, pair_moments

C = F.col


def _merged(side_a: str, side_b: str) -> dict[str, Column]:
    """Pooled (both arms) centred sums from two arms' moments (pairwise update)."""
    na, nb = C(f"n_{side_a}").cast("double"), C(f"n_{side_b}").cast("double")
    n = na + nb
    dx = C(f"mean_x_{side_b}") - C(f"mean_x_{side_a}")
    dy = C(f"mean_y_{side_b}") - C(f"mean_y_{side_a}")
    w = div(na * nb, n)
    return {
        "n": n,
        "mean_x": C(f"mean_x_{side_a}") + dx * div(nb, n),
        "mean_y": C(f"mean_y_{side_a}") + dy * div(nb, n),
        "sxx": (na - 1) * C(f"var_x_{side_a}") + (nb - 1) * C(f"var_x_{side_b}") + w * dx * dx,
        "syy": (na - 1) * C(f"var_y_{side_a}") + (nb - 1) * C(f"var_y_{side_b}") + w * dy * dy,
        "sxy": (na - 1) * C(f"cov_{side_a}") + (nb - 1) * C(f"cov_{side_b}") + w * dx * dy,
    }


def strength(rho: Column) -> Column:
    a = F.abs(rho)
    return (
        F.when(a < 0.1, "weak").when(a < 0.3, "modest").when(a < 0.6, "moderate")
        .when(a.isNotNull(), "strong")
    )


def pooled_regression(df: DataFrame, keys: Sequence[str], pre: str, post: str) -> DataFrame:
    """theta = cov/var over all arms, 0 for a constant covariate; plus its mean."""
    x, y = num(pre), num(post)
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    agg = df.groupBy(*keys).agg(
        F.count(F.when(both, 1)).alias("n"),
        F.count(F.when(~both, 1)).alias("n_incomplete"),
        F.avg(px).alias("mean_pre"),
        F.avg(py).alias("mean_post"),
        F.var_samp(px).alias("var_pre"),
        F.var_samp(py).alias("var_post"),
        F.covar_samp(px, py).alias("cov"),
        F.bool_and(F.when(both, x == y)).alias("_same"),
    )
    theta = F.when(C("var_pre") > 0, div(C("cov"), C("var_pre"))).otherwise(0.0)
    return agg.withColumns(
        {
            "error": F.when(C("n") < 2, "insufficient_data").when(C("_same"), "identical_pre_post"),
            "theta": theta,
        }
    ).drop("_same")


def correlation(df: DataFrame, keys: Sequence[str], pre: str, post: str) -> DataFrame:
    out = pooled_regression(df, keys, pre, post)
    flat = (C("var_pre") == 0) | (C("var_post") == 0)
    rho = F.when(flat, 0.0).otherwise(div(C("cov"), F.sqrt(C("var_pre") * C("var_post"))))
    return out.withColumn("correlation", F.when(C("error").isNull(), rho))


def variance_reduction(df: DataFrame, keys: Sequence[str], pre: str, post: str) -> DataFrame:
    out = correlation(df, keys, pre, post)
    return out.withColumns(
        {
            "variance_reduction_pct": C("correlation") * C("correlation") * 100,
            "strength": strength(C("correlation")),
        }
    )


def cuped_adjust(
    df: DataFrame, keys: Sequence[str], pre: str, post: str, out: str = "adjusted"
) -> DataFrame:
    """Row-level Y - theta (X - mean X); theta comes from a reduced frame."""
    reg = pooled_regression(df, keys, pre, post).select(
        *keys, F.when(C("error").isNull(), C("theta")).alias("theta"), "mean_pre"
    )
    return df.join(small_side(reg, "regression"), list(keys), "left").withColumn(
        out, num(post) - C("theta") * (num(pre) - C("mean_pre"))
    )


def cuped_from_moments(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adjusted Welch test; var(Y - theta X) comes from the joint moments."""
    merged = _merged("control", "treatment")
    step = pairs.withColumns({f"_{k}": v for k, v in merged.items()})
    step = step.withColumn("theta", F.when(C("_sxx") > 0, div(C("_sxy"), C("_sxx"))).otherwise(0.0))
    flat = (C("_sxx") == 0) | (C("_syy") == 0)
    step = step.withColumn(
        "rho", F.when(flat, 0.0).otherwise(div(C("_sxy"), F.sqrt(C("_sxx") * C("_syy"))))
    )

    def adj_var(side: str) -> Column:
        v = (
            C(f"var_y_{side}")
            - 2 * C("theta") * C(f"cov_{side}")
            + C("theta") * C("theta") * C(f"var_x_{side}")
        )
        return F.greatest(v, F.lit(0.0))

    def adj_mean(side: str) -> Column:
        return C(f"mean_y_{side}") - C("theta") * (C(f"mean_x_{side}") - C("_mean_x"))

    step = step.withColumns(
        {
            "_av_c": adj_var("control"), "_av_t": adj_var("treatment"),
            "_am_c": adj_mean("control"), "_am_t": adj_mean("treatment"),
        }
    )

    def pooled(vc: Column, vt: Column) -> Column:
        nc, nt = C("n_control"), C("n_treatment")
        return div((nc - 1) * vc + (nt - 1) * vt, nc + nt - 2)

    raw, adj = pooled(C("var_y_control"), C("var_y_treatment")), pooled(C("_av_c"), C("_av_t"))
    step = step.withColumns(
        {
            "raw_diff": C("mean_y_treatment") - C("mean_y_control"),
            "expected_reduction_pct": C("rho") * C("rho") * 100,
            "realized_reduction_pct": F.when(raw > 0, (1 - div(adj, raw)) * 100),
            "_same": C("identical_control") & C("identical_treatment"),
        }
    )
    keep = [c for c in pairs.columns if not re_stat(c)]
    tested = welch_from_moments(
        step.select(
            *keep,
            "n_control", "n_treatment",
            (C("n_incomplete_control") + C("n_incomplete_treatment")).alias("n_incomplete"),
            "theta", "rho", "raw_diff", "expected_reduction_pct", "realized_reduction_pct", "_same",
            C("_am_c").alias("mean_control"), C("_am_t").alias("mean_treatment"),
            C("_av_c").alias("var_control"), C("_av_t").alias("var_treatment"),
        ),
        alpha,
    )
    return tested.withColumn(
        "error", F.when(C("_same"), "identical_pre_post").otherwise(C("error"))
    ).drop("_same")


def re_stat(name: str) -> bool:
    return name.endswith("_control") or name.endswith("_treatment")


def cuped_welch_test(
    df: DataFrame,
    keys: Sequence[str],
    pre: str = "pre_value",
    post: str = "value",
    arm: str = "arm",
    control: str = "control",
    alpha: float = 0.05,
) -> DataFrame:
    m = pair_moments(df, keys, pre, post, arm)
    return cuped_from_moments(pair_arms(m, keys, arm, control), alpha)
