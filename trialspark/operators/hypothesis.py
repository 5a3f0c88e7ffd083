"""Two-sample tests as columns over a paired moments frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import div, lift_percent, magnitude, null_double, null_string
from ..functions.distributions import norm_two_sided, t_quantile, t_two_sided, z_value
from .moments import arm_moments, pair_arms, pair_moments

C = F.col


def _with(frame: DataFrame, /, **cols: Column) -> DataFrame:
    return frame.withColumns(cols)


def welch_from_moments(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Welch's t test on `n/mean/var` of control and treatment."""
    few = (F.coalesce(C("n_control"), F.lit(0)) < 2) | (F.coalesce(C("n_treatment"), F.lit(0)) < 2)
    step = _with(
        pairs,
        diff=C("mean_treatment") - C("mean_control"),
        _vc=div(C("var_control"), C("n_control")),
        _vt=div(C("var_treatment"), C("n_treatment")),
    )
    step = _with(step, se=F.sqrt(C("_vc") + C("_vt")))
    step = _with(
        step,
        error=F.when(few, "insufficient_data").when(C("se") == 0, "zero_variance"),
        df=F.when(
            ~few & (C("se") > 0),
            div(
                (C("_vc") + C("_vt")) * (C("_vc") + C("_vt")),
                div(C("_vc") * C("_vc"), C("n_control") - 1)
                + div(C("_vt") * C("_vt"), C("n_treatment") - 1),
            ),
        ),
    )
    ok = C("error").isNull()
    pooled = F.sqrt(
        div(
            (C("n_control") - 1) * C("var_control") + (C("n_treatment") - 1) * C("var_treatment"),
            C("n_control") + C("n_treatment") - 2,
        )
    )
    step = _with(
        step,
        t_stat=F.when(ok, div(C("diff"), C("se"))),
        _crit=F.when(ok, t_quantile(1 - alpha / 2, C("df"))),
        cohens_d=F.when(ok, div(C("diff"), pooled)),
    )
    step = _with(
        step,
        p_value=F.when(ok, t_two_sided(C("t_stat"), C("df"))),
        ci_lower=C("diff") - C("_crit") * C("se"),
        ci_upper=C("diff") + C("_crit") * C("se"),
        effect_size=magnitude(F.abs(C("cohens_d"))),
        lift_pct=F.when(ok, lift_percent(C("diff"), C("mean_control"))),
    )
    return _with(step, significant=C("p_value") < alpha).drop("_vc", "_vt", "_crit")


def welch_test(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "value",
    arm: str = "arm",
    control: str = "control",
    alpha: float = 0.05,
) -> DataFrame:
    return welch_from_moments(pair_arms(arm_moments(df, keys, value, arm), keys, arm, control), alpha)


def proportion_from_counts(
    pairs: DataFrame,
    alpha: float = 0.05,
    success: tuple[str, str] = ("total_control", "total_treatment"),
    trials: tuple[str, str] = ("n_control", "n_treatment"),
) -> DataFrame:
    """Pooled z test of two rates with an unpooled Wald interval."""
    xc, xt = C(success[0]).cast("double"), C(success[1]).cast("double")
    nc, nt = C(trials[0]), C(trials[1])
    z_crit = F.lit(z_value(1 - alpha / 2))
    empty = (F.coalesce(nc, F.lit(0)) == 0) | (F.coalesce(nt, F.lit(0)) == 0)
    step = _with(
        pairs,
        error=F.when(empty, "insufficient_data"),
        rate_control=div(xc, nc),
        rate_treatment=div(xt, nt),
        _pool=div(xc + xt, nc + nt),
    )
    rc, rt = C("rate_control"), C("rate_treatment")
    step = _with(
        step,
        diff=rt - rc,
        _se0=F.sqrt(C("_pool") * (1 - C("_pool")) * (div(F.lit(1), nc) + div(F.lit(1), nt))),
        se=F.sqrt(div(rc * (1 - rc), nc) + div(rt * (1 - rt), nt)),
    )
    ok = C("error").isNull()
    step = _with(
        step,
        z_stat=F.when(ok, F.when(C("_se0") == 0, 0.0).otherwise(div(C("diff"), C("_se0")))),
        ci_lower=F.when(ok, C("diff") - z_crit * C("se")),
        ci_upper=F.when(ok, C("diff") + z_crit * C("se")),
        lift_pct=F.when(
            ok, F.when(rc > 0, div(C("diff"), rc) * 100).otherwise(F.lit(float("inf")))
        ),
    )
    step = _with(
        step, p_value=F.when(C("_se0") == 0, F.when(ok, 1.0)).otherwise(norm_two_sided(C("z_stat")))
    )
    return _with(step, significant=C("p_value") < alpha).drop("_pool", "_se0")


def proportion_test(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "converted",
    arm: str = "arm",
    control: str = "control",
    alpha: float = 0.05,
) -> DataFrame:
    """`value` is a 0/1 outcome per unit."""
    return proportion_from_counts(pair_arms(arm_moments(df, keys, value, arm), keys, arm, control), alpha)


def _delta_variance(side: str) -> Column:
    """Variance of a ratio of means by the delta method (x over y)."""
    ratio = div(C(f"sum_x_{side}"), C(f"sum_y_{side}"))
    spread = (
        C(f"var_x_{side}")
        - 2 * ratio * C(f"cov_{side}")
        + ratio * ratio * C(f"var_y_{side}")
    )
    return div(spread, C(f"mean_y_{side}") * C(f"mean_y_{side}") * C(f"n_{side}"))


def ratio_from_moments(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """z test of sum(num)/sum(den); the unit is the analysis row, not the event."""
    z_crit = F.lit(z_value(1 - alpha / 2))
    bad = F.lit(False)
    for side in ("control", "treatment"):
        bad = bad | (F.coalesce(C(f"n_{side}"), F.lit(0)) < 2) | (
            F.coalesce(C(f"sum_y_{side}"), F.lit(0.0)) == 0
        )
    step = _with(
        pairs,
        error=F.when(bad, "insufficient_data"),
        ratio_control=F.when(~bad, div(C("sum_x_control"), C("sum_y_control"))),
        ratio_treatment=F.when(~bad, div(C("sum_x_treatment"), C("sum_y_treatment"))),
        se=F.when(
            ~bad, F.sqrt(F.greatest(F.lit(0.0), _delta_variance("control") + _delta_variance("treatment")))
        ),
    )
    step = _with(step, diff=C("ratio_treatment") - C("ratio_control"))
    step = _with(
        step,
        z_stat=F.when(C("se") == 0, 0.0).otherwise(div(C("diff"), C("se"))),
        ci_lower=C("diff") - z_crit * C("se"),
        ci_upper=C("diff") + z_crit * C("se"),
        lift_pct=lift_percent(C("diff"), C("ratio_control")),
    )
    step = _with(step, p_value=F.when(C("se") == 0, 1.0).otherwise(norm_two_sided(C("z_stat"))))
    return _with(step, significant=C("p_value") < alpha)


def ratio_metric_test(
    df: DataFrame,
    keys: Sequence[str],
    numerator: str = "numerator",
    denominator: str = "denominator",
    arm: str = "arm",
    control: str = "control",
    alpha: float = 0.05,
) -> DataFrame:
    m = pair_moments(df, keys, numerator, denominator, arm)
    return ratio_from_moments(pair_arms(m, keys, arm, control), alpha)


def cohens_d(pairs: DataFrame) -> DataFrame:
    """Standardized mean difference; 0 / Unknown where it cannot be formed."""
    few = (C("n_control") < 2) | (C("n_treatment") < 2)
    pooled = F.sqrt(
        div(
            (C("n_control") - 1) * C("var_control") + (C("n_treatment") - 1) * C("var_treatment"),
            C("n_control") + C("n_treatment") - 2,
        )
    )
    step = _with(pairs, _sd=F.when(~few, pooled))
    known = C("_sd") > 0
    step = _with(
        step,
        d=F.when(known, div(C("mean_treatment") - C("mean_control"), C("_sd"))).otherwise(0.0),
    )
    return _with(
        step, magnitude=F.when(known, magnitude(F.abs(C("d")))).otherwise("Unknown")
    ).drop("_sd")


def cohens_h(
    df: DataFrame, rate_control: str = "rate_control", rate_treatment: str = "rate_treatment"
) -> DataFrame:
    """Arcsine difference of two rates; NULL outside [0, 1]."""

    def phi(name: str) -> Column:
        p = C(name)
        return F.when(p.between(0, 1), 2 * F.asin(F.sqrt(p)))

    step = _with(df, h=phi(rate_treatment) - phi(rate_control))
    return _with(
        step,
        magnitude=magnitude(F.abs(C("h"))),
        direction=F.when(C("h") > 0, "higher").when(C("h") < 0, "lower").when(C("h") == 0, "equal"),
    )


def relative_lift(
    df: DataFrame, control: str = "mean_control", treatment: str = "mean_treatment"
) -> DataFrame:
    diff = C(treatment) - C(control)
    at_zero = F.when(diff != 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    return _with(df, absolute_diff=diff, lift_pct=lift_percent(diff, C(control), at_zero))


def with_trace(df: DataFrame, inputs: Sequence[str], intermediate: Sequence[str], formula: str) -> DataFrame:
    """Carry inputs, intermediates and the formula's name beside each result."""
    return _with(
        df,
        computation_trace=F.struct(
            F.struct(*[C(c) for c in inputs]).alias("inputs"),
            F.struct(*[C(c) for c in intermediate]).alias("intermediate"),
            F.lit(formula).alias("formula"),
        ),
    )


def metric_dispatch(tests: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Union of the test frames of each metric type, on their common columns."""
    out = None
    for kind, frame in tests.items():
        part = frame.select(
            *[
                C(c) if c in frame.columns else (null_string() if c == "error" else null_double()).alias(c)
                for c in columns
            ],
            F.lit(kind).alias("metric_type"),
        )
        out = part if out is None else out.unionByName(part)
    return out
