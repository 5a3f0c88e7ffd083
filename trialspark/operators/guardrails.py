"""Two guardrail rules, kept apart on purpose: non-inferiority and health."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import GUARDRAIL_MARGINAL_P
from ..functions.columns import div, null_double
from ..functions.distributions import norm_sf, t_quantile, t_sf, z_value
from ..session import materialize
from .hypothesis import proportion_from_counts, welch_from_moments
from .moments import metric_moments, pair_arms

C = F.col


def _one_sided(df: DataFrame, crit: Column, p: Column, nim: float, invert: bool) -> DataFrame:
    step = df.withColumns(
        {
            "oriented_effect": -C("point_estimate") if invert else C("point_estimate"),
            "ni_margin": -F.abs(F.lit(nim) * C("baseline")),
        }
    )
    step = step.withColumn("z_stat", div(C("oriented_effect") - C("ni_margin"), C("se")))
    ok = C("error").isNull()
    step = step.withColumns(
        {
            "worst_case_effect": F.when(ok, C("oriented_effect") - crit * C("se")),
            "p_value": F.when(ok, p),
        }
    )
    return step.withColumn(
        "verdict",
        F.when(ok & (C("oriented_effect") < C("ni_margin")), "BLOCK")
        .when(ok & (C("worst_case_effect") < C("ni_margin")), "WARNING")
        .when(ok, "PASS"),
    )


def guardrail_test(
    pairs: DataFrame,
    metric_type: str = "mean",
    nim_relative: float = 0.02,
    alpha: float = 0.05,
    invert: bool = False,
) -> DataFrame:
    """One-sided non-inferiority against a margin relative to the control baseline."""
    nc, nt = C("n_control"), C("n_treatment")
    if metric_type == "mean":
        vc, vt = div(C("var_control"), nc), div(C("var_treatment"), nt)
        base, est = C("mean_control"), C("mean_treatment") - C("mean_control")
        se = F.sqrt(vc + vt)
        few = (nc < 2) | (nt < 2)
    elif metric_type == "proportion":
        rc, rt = div(C("total_control"), nc), div(C("total_treatment"), nt)
        base, est = rc, rt - rc
        se = F.sqrt(div(rc * (1 - rc), nc) + div(rt * (1 - rt), nt))
        few = (nc < 1) | (nt < 1)
    else:
        raise ValueError(f"metric_type must be 'mean' or 'proportion', got {metric_type!r}")
    step = pairs.withColumns({"baseline": base, "point_estimate": est, "se": se})
    step = step.withColumn(
        "error",
        F.when(F.coalesce(few, F.lit(True)), "insufficient_data")
        .when(C("se") == 0, "zero_variance")
        .when(C("baseline") == 0, "zero_baseline"),
    )
    if metric_type == "mean":
        vc, vt = div(C("var_control"), nc), div(C("var_treatment"), nt)
        df = div((vc + vt) * (vc + vt), div(vc * vc, nc - 1) + div(vt * vt, nt - 1))
        step = step.withColumn("df", F.when(C("error").isNull(), df))
        crit, p = t_quantile(1 - alpha, C("df")), t_sf(C("z_stat"), C("df"))
    else:
        crit, p = F.lit(z_value(1 - alpha)), norm_sf(C("z_stat"))
    return _one_sided(step, crit, p, nim_relative, invert)


def _spec(metric: str, specs: Mapping[str, Mapping], key: str, default) -> Column:
    out = F.lit(default)
    for name, spec in specs.items():
        if key in spec:
            out = F.when(C(metric) == name, F.lit(spec[key])).otherwise(out)
    return out


def guardrail_health(
    df: DataFrame,
    keys: Sequence[str],
    thresholds: Mapping[str, Mapping],
    arm: str = "arm",
    control: str | None = "control",
    alpha: float = 0.05,
) -> DataFrame:
    """Every guardrail metric in one scan; a two-sided interval against its margin.

    `thresholds`: metric -> {nim, direction: decrease|increase, type: continuous|binary}.
    A metric that is not a column is reported as WARNING, also when none is.
    """
    absent = [m for m in thresholds if m not in df.columns]
    values = {m: null_double() if m in absent else m for m in thresholds}
    moments = metric_moments(df, keys, values, arm)
    pairs = pair_arms(moments, [*keys, "metric"], arm, control)
    binary = [m for m in values if m not in absent and str(thresholds[m].get("type", "continuous")).lower() == "binary"]
    is_binary = C("metric").isin(binary) if binary else F.lit(False)
    if binary and len(binary) < len(values):
        # Two tests read the few paired rows; stored, they come from one scan.
        pairs = materialize(pairs, "guardrail-moments")
    common = ["diff", "ci_lower", "ci_upper", "p_value", "error"]
    base = [*keys, "metric", arm]
    mean = welch_from_moments(pairs.where(~is_binary), alpha).select(
        *base, C("mean_control").alias("baseline"), *common
    )
    rate = proportion_from_counts(pairs.where(is_binary), alpha).select(
        *base, C("rate_control").alias("baseline"), *common
    )
    tested = mean.unionByName(rate) if binary else mean
    nim = F.abs(_spec("metric", thresholds, "nim", 0.0).cast("double"))
    direction = _spec("metric", thresholds, "direction", "decrease")
    if absent:
        missing = F.when(C("metric").isin(absent), "metric_missing").otherwise(C("error"))
        tested = tested.withColumn("error", missing)
    step = tested.withColumns({"nim": nim, "direction": direction})
    step = step.withColumn(
        "nim_absolute", F.when(C("baseline") != 0, C("nim") * F.abs("baseline")).otherwise(C("nim"))
    )
    down = C("direction") == "decrease"
    step = step.withColumns(
        {
            "margin": F.when(down, -C("nim_absolute")).otherwise(C("nim_absolute")),
            "worst_case_effect": F.when(down, C("ci_lower")).otherwise(C("ci_upper")),
        }
    )
    beyond = F.when(down, C("worst_case_effect") < C("margin")).otherwise(
        C("worst_case_effect") > C("margin")
    )
    wrong_way = F.when(down, C("diff") < 0).otherwise(C("diff") > 0)
    return step.withColumn(
        "verdict",
        F.when(C("error").isNotNull(), "WARNING")
        .when(beyond, "BLOCK")
        .when(wrong_way & (C("p_value") < GUARDRAIL_MARGINAL_P), "WARNING")
        .otherwise("PASS"),
    )


def worst_verdict(df: DataFrame, keys: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """Worst-wins summary with the flagged metrics in order."""
    rank = F.when(C(verdict) == "BLOCK", 2).when(C(verdict) == "WARNING", 1).otherwise(0)
    agg = df.groupBy(*keys).agg(
        F.max(rank).alias("_r"),
        F.array_distinct(
            F.array_compact(F.sort_array(F.collect_set(F.when(C(verdict) != "PASS", C("metric")))))
        ).alias("flagged_metrics"),
    )
    label = F.when(C("_r") == 2, "BLOCK").when(C("_r") == 1, "WARNING").otherwise("PASS")
    return agg.select(*keys, label.alias("verdict"), "flagged_metrics")
