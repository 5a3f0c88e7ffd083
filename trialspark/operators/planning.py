"""Sizing: baselines come from Spark aggregates, scenarios are rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import MARGINAL_DAYS, RATIO_LARGE_N, RATIO_VIABLE_N, VIABLE_DAYS
from ..functions.columns import div, let, num
from ..functions.distributions import node_table, norm_sf, t_quantile, z_value

C = F.col


def baselines(df: DataFrame, keys: Sequence[str], value: str, unit: str | None = None) -> DataFrame:
    """Mean, spread and size per segment, the inputs of every sizing function."""
    v = num(value)
    n = F.count_distinct(C(unit)) if unit else F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.avg(v).alias("baseline"), F.stddev_samp(v).alias("baseline_std"), n.alias("n_units")
    )


def scenarios(df: DataFrame, **grid: Sequence[float]) -> DataFrame:
    """One row per input row and combination of the literal scenario values."""
    out = df
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return out


def _two_sided_power_n(effect: Column, alpha: float, power: float) -> Column:
    """n per arm with P(|Z + effect sqrt(n/2)| > z) = power, i.e. n = 2 (shift / effect)^2."""
    z = z_value(1 - alpha / 2)
    d = _two_sided_shift(z, power)
    return 2 * div(F.lit(d), effect) * div(F.lit(d), effect)


def _two_sided_shift(z: float, power: float) -> float:
    """Plan-time constant: the normal shift that gives the wanted power."""
    d = z + z_value(power)
    for _ in range(50):
        f = 0.5 * math.erfc((z - d) / math.sqrt(2)) + 0.5 * math.erfc((z + d) / math.sqrt(2)) - power
        g = (math.exp(-((z - d) ** 2) / 2) - math.exp(-((z + d) ** 2) / 2)) / math.sqrt(2 * math.pi)
        d -= f / g
    return d


def power_proportion(
    df: DataFrame, rate: str = "baseline", mde: str = "mde_relative", alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """n per arm for a rate, from Cohen's h."""
    p1 = C(rate)
    p2 = p1 + p1 * C(mde)
    bad1, bad2 = ~((p1 > 0) & (p1 < 1)), ~((p2 > 0) & (p2 < 1))
    error = F.when(F.coalesce(bad1, F.lit(True)), "baseline_out_of_range").when(
        F.coalesce(bad2, F.lit(True)), "treatment_out_of_range"
    )
    step = df.withColumns({"error": error, "treatment_rate": p2, "absolute_difference": p1 * C(mde)})
    ok = C("error").isNull()
    step = step.withColumn(
        "cohens_h", F.when(ok, 2 * (F.asin(F.sqrt(F.when(ok, p2))) - F.asin(F.sqrt(F.when(ok, p1)))))
    )
    n = F.ceil(_two_sided_power_n(F.abs(C("cohens_h")), alpha, power))
    return step.withColumn("sample_size_per_group", n).withColumn(
        "total_sample_size", C("sample_size_per_group") * 2
    )


def t_power(n: Column, d: Column, alpha: float) -> Column:
    """Power of the two-sided two-sample t test: P(|T'| > t), T' non-central.

    Conditional on the pooled scale s the statistic is normal, so power is the
    mean of two normal tails over the density of s (chi / sqrt(df)).
    """
    return let(
        {"n": n, "d": d},
        lambda r: _t_power(2 * r["n"] - 2, r["d"] * F.sqrt(r["n"] / 2), alpha),
    )


def _t_power(df: Column, shift: Column, alpha: float) -> Column:
    spread = F.lit(9.0) / F.sqrt(2 * df)
    lo = F.greatest(F.lit(0.0), 1 - spread)
    hi = 1 + spread * 1.5 + F.when(df < 20, F.lit(3.0)).otherwise(F.lit(0.0))
    ends = {
        "df": df, "shift": shift, "lo": lo, "width": hi - lo,
        "crit": t_quantile(1 - alpha / 2, df),
    }

    def body(r: Column) -> Column:
        def node(acc: Column, nd: Column) -> Column:
            def add(v: Column) -> Column:
                s, w = v["s"], v["w"]
                tails = norm_sf(r["crit"] * s - r["shift"]) + norm_sf(r["crit"] * s + r["shift"])
                return F.struct((acc["m"] + w).alias("m"), (acc["p"] + w * tails).alias("p"))

            s = r["lo"] + r["width"] * nd["x"]
            weight = nd["w"] * F.exp((r["df"] - 1) * F.log(s) - r["df"] * (s * s - 1) / 2)
            return let({"s": s, "w": weight}, add)

        start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("p"))
        return F.aggregate(node_table(4, 20), start, node, lambda acc: div(acc["p"], acc["m"]))

    return let(ends, body)


def power_mean(
    df: DataFrame,
    mean: str = "baseline",
    std: str = "baseline_std",
    mde: str = "mde_relative",
    alpha: float = 0.05,
    power: float = 0.8,
) -> DataFrame:
    """n per arm for a mean: the smallest whole n whose t-test power suffices.

    Power grows with n, and the answer lies within a few units of the normal
    solution plus z^2/4, so a short run of candidates settles it.
    """
    bad = ~(C(std) > 0)
    step = df.withColumns(
        {
            "error": F.when(F.coalesce(bad, F.lit(True)), "zero_variance").when(
                C(mean) * C(mde) == 0, "zero_effect"
            ),
            "absolute_difference": F.abs(C(mean) * C(mde)),
        }
    )
    ok = C("error").isNull()
    step = step.withColumn("cohens_d", F.when(ok, div(C("absolute_difference"), C(std))))
    z = z_value(1 - alpha / 2)
    seed = F.floor(_two_sided_power_n(C("cohens_d"), alpha, power) + z * z / 4).cast("long")
    step = step.withColumn("_seed", F.when(ok, seed))
    candidates = F.sequence(F.greatest(F.lit(2).cast("long"), C("_seed") - 3), C("_seed") + 4)
    enough = F.filter(
        candidates, lambda n: t_power(n.cast("double"), C("cohens_d"), alpha) >= power
    )
    n = F.when(ok, F.try_element_at(enough, F.lit(1)))
    return step.withColumn("sample_size_per_group", n).withColumn(
        "total_sample_size", C("sample_size_per_group") * 2
    ).drop("_seed")


def power_ratio(
    df: DataFrame,
    alpha: float = 0.05,
    power: float = 0.8,
    mde: str = "mde_relative",
) -> DataFrame:
    """n per arm for a ratio metric from num/den mean, std and correlation columns."""
    ratio = div(C("num_mean"), C("den_mean"))
    step = df.withColumns({"baseline_ratio": ratio}).withColumn(
        "mde_absolute", F.abs(C("baseline_ratio") * C(mde))
    )
    r = C("baseline_ratio")
    var = div(
        C("num_std") * C("num_std") + r * r * C("den_std") * C("den_std")
        - 2 * r * C("correlation") * C("num_std") * C("den_std"),
        C("den_mean") * C("den_mean"),
    )
    step = step.withColumn("var_ratio_per_unit", var)
    bad = ~(C("var_ratio_per_unit") > 0) | (C("mde_absolute") == 0)
    step = step.withColumn("error", F.when(F.coalesce(bad, F.lit(True)), "non_positive_variance"))
    n = _closed_form_n(C("var_ratio_per_unit"), C("mde_absolute"), alpha, power)
    step = step.withColumn("n_per_group", F.when(C("error").isNull(), n))
    return step.withColumns(
        {
            "total_n": C("n_per_group") * 2,
            "viability": F.when(C("n_per_group") <= RATIO_VIABLE_N, "VIABLE")
            .when(C("n_per_group") <= RATIO_LARGE_N, "LARGE")
            .when(C("n_per_group").isNotNull(), "INFEASIBLE"),
        }
    )


def _closed_form_n(variance: Column, effect: Column, alpha: float, power: float) -> Column:
    z = z_value(1 - alpha / 2) + z_value(power)
    return F.ceil(div(F.lit(z * z * 2) * variance, effect * effect))


def ratio_baselines(df: DataFrame, keys: Sequence[str], numerator: str, denominator: str) -> DataFrame:
    x, y = num(numerator), num(denominator)
    return df.groupBy(*keys).agg(
        F.avg(x).alias("num_mean"), F.avg(y).alias("den_mean"),
        F.stddev_samp(x).alias("num_std"), F.stddev_samp(y).alias("den_std"),
        F.corr(x, y).alias("correlation"),
    )


def detectable_effect_proportion(
    df: DataFrame, n: str = "n_per_group", rate: str = "baseline", alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Smallest detectable rate change for a fixed n, by inverting Cohen's h."""
    d = _two_sided_shift(z_value(1 - alpha / 2), power)
    few = C(n) < 2
    h = F.lit(d) * F.sqrt(div(F.lit(2.0), C(n)))
    p2 = F.sin(F.asin(F.sqrt(C(rate))) + h / 2)
    step = df.withColumns(
        {
            "error": F.when(few, "insufficient_data"),
            "mde_absolute": F.when(~few, p2 * p2 - C(rate)),
        }
    )
    return step.withColumn(
        "mde_relative",
        F.when(C(rate) > 0, div(C("mde_absolute"), C(rate))).otherwise(F.lit(float("inf"))),
    )


def detectable_effect_mean(
    df: DataFrame, n: str = "n_per_group", std: str = "baseline_std", alpha: float = 0.05, power: float = 0.8
) -> DataFrame:
    """Smallest detectable mean change for a fixed n: secant steps on t-test power."""
    few = C(n) < 2
    shift = _two_sided_shift(z_value(1 - alpha / 2), power)

    def solve(r: Column) -> Column:
        def secant(acc: Column, _: Column) -> Column:
            def move(v: Column) -> Column:
                slope = div(v["fb"] - acc["fa"], acc["b"] - acc["a"])
                jump = F.coalesce(div(F.lit(power) - v["fb"], slope), F.lit(0.0))
                return F.struct(acc["b"].alias("a"), v["fb"].alias("fa"), (acc["b"] + jump).alias("b"))

            return let({"fb": t_power(r["n"], acc["b"], alpha)}, move)

        near = r["start"] * 0.98
        state = F.struct(
            near.alias("a"), t_power(r["n"], near, alpha).alias("fa"), r["start"].alias("b")
        )
        return F.aggregate(F.sequence(F.lit(1), F.lit(6)), state, secant, lambda acc: acc["b"])

    size = F.when(~few, C(n).cast("double"))
    start = F.lit(shift) * F.sqrt(div(F.lit(2.0), size)) * (1 + div(F.lit(1.0), size))
    d = let({"n": size, "start": start}, solve)
    step = df.withColumns({"error": F.when(few, "insufficient_data"), "cohens_d": F.when(~few, d)})
    return step.withColumn("mde_absolute", C("cohens_d") * C(std))


def duration_estimate(
    df: DataFrame,
    n_required: str = "total_sample_size",
    daily_traffic: str = "daily_traffic",
    allocation: float = 1.0,
) -> DataFrame:
    step = df.withColumn("daily_enrollment", C(daily_traffic).cast("double") * allocation)
    days = F.when(C(daily_traffic) > 0, F.ceil(div(C(n_required), C("daily_enrollment"))))
    step = step.withColumn("days", days)
    return step.withColumns(
        {
            "weeks": F.round(C("days") / 7, 1),
            "viable": F.when(C("days") <= VIABLE_DAYS, "VIABLE")
            .when(C("days") <= MARGINAL_DAYS, "MARGINAL")
            .when(C("days").isNotNull(), "NOT_VIABLE"),
        }
    )


def power_sensitivity_table(
    df: DataFrame,
    mde_values: Sequence[float],
    daily_traffic_values: Sequence[float],
    rate: str = "baseline",
    alpha: float = 0.05,
    power: float = 0.8,
) -> DataFrame:
    """MDE x traffic grid per baseline row; impossible combinations drop out."""
    sized = power_proportion(scenarios(df, mde_relative=mde_values), rate, "mde_relative", alpha, power)
    grid = scenarios(sized.where(C("error").isNull()), daily_traffic=daily_traffic_values)
    return duration_estimate(grid).drop("error")


def extension_estimate(
    df: DataFrame,
    current_n: str = "current_n",
    effect: str = "observed_effect",
    variance: str = "baseline_variance",
    daily_traffic: str = "daily_traffic",
    required_power: float = 0.8,
    alpha: float = 0.05,
) -> DataFrame:
    """More units and days to reach power at the observed effect."""
    good = (C(current_n) >= 2) & (C(effect) != 0) & (C(variance) > 0) & (C(daily_traffic) > 0)
    step = df.withColumn("error", F.when(~F.coalesce(good, F.lit(False)), "invalid_input"))
    need = _closed_form_n(C(variance), C(effect), alpha, required_power)
    step = step.withColumn("required_n_per_group", F.when(C("error").isNull(), need))
    per_arm = C(daily_traffic) / 2
    step = step.withColumn(
        "additional_n_needed",
        F.greatest(F.lit(0).cast("long"), C("required_n_per_group") - C(current_n)),
    )
    step = step.withColumn("additional_days", F.ceil(div(C("additional_n_needed"), per_arm)))
    return step.withColumns(
        {
            "total_duration": F.when(
                C("error").isNull(), F.ceil(div(C(current_n), per_arm)) + C("additional_days")
            ),
            "feasible": C("additional_days") <= MARGINAL_DAYS,
        }
    )


def assignment_surface(
    df: DataFrame, keys: Sequence[str], unit: str, ts: str, segments: Sequence[str] = ()
) -> DataFrame:
    """Units available and accrual per day, no outcomes.

    First days per unit come first, so the distinct count is a plain count.
    """
    first = df.groupBy(*keys, *segments, unit).agg(F.min(ts).alias("_first"))
    return (
        first.groupBy(*keys, *segments)
        .agg(
            F.count(F.lit(1)).alias("n_units"),
            F.min("_first").alias("first_seen"),
            F.max("_first").alias("last_seen"),
        )
        .withColumn("days", F.date_diff(F.to_date("last_seen"), F.to_date("first_seen")) + 1)
        .withColumn("units_per_day", div(C("n_units"), C("days")))
    )
