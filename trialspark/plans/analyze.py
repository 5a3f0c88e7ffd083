"""Assignment and facts to a verdict per experiment, in one scan of the unit frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..fixed_values import SRM_PASS_P, SRM_THRESHOLD
from ..functions.columns import div
from ..functions.distributions import chi2_sf, t_quantile
from ..operators.hypothesis import welch_from_moments
from ..operators.moments import metric_moments, pair_arms
from .verdict import map_confidence, walk_tree

C = F.col


def with_srm(moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the equal-split sample-ratio p-value of every cell to its moment rows.

    Assigned units are compared, not values: a metric that is missing for many
    units of one arm says nothing about the split.  Windows over the reduced frame, partitioned like the arm pairing that
    follows, so the check costs no further exchange.
    """
    cell = Window.partitionBy(*keys)
    step = moments.withColumns(
        {"_total": F.sum("units").over(cell), "_k": F.count(F.lit(1)).over(cell)}
    ).withColumn("_e", div(C("_total"), C("_k")))
    gap = C("units") - C("_e")
    chi = F.sum(div(gap * gap, C("_e"))).over(cell)
    return step.withColumn("srm_p", chi2_sf(chi, C("_k") - 1)).drop("_total", "_k", "_e")


def with_ci90(tests: DataFrame) -> DataFrame:
    """The 90% interval beside the 95% one."""
    crit = F.when(C("error").isNull(), t_quantile(0.95, C("df")))
    return tests.withColumn("_c90", crit).withColumns(
        {
            "ci_lower_90": C("diff") - C("_c90") * C("se"),
            "ci_upper_90": C("diff") + C("_c90") * C("se"),
        }
    ).drop("_c90")


def metric_effects(
    units: DataFrame, keys: Sequence[str], metrics: Sequence[str], arm: str = "arm", control: str = "control"
) -> DataFrame:
    """Welch effects with 90% and 95% intervals and the SRM p-value, long by metric.

    `units` has a row per assigned unit; a NULL value takes its unit out of that
    metric's test only.
    """
    moments = metric_moments(units, keys, {m: m for m in metrics}, arm)
    cell = [*keys, "metric"]
    pairs = pair_arms(with_srm(moments, cell), cell, arm, control)
    return with_ci90(welch_from_moments(pairs))


def tree_inputs(
    effects: DataFrame,
    keys: Sequence[str],
    primary: str,
    guardrails: Mapping[str, str],
    n_required: int,
    mde_pct: float,
    direction: str = "higher_is_better",
    early: str | None = None,
    late: str | None = None,
    arm: str = "arm",
) -> DataFrame:
    """One ladder row per experiment and treatment arm from the long effects.

    `guardrails` maps metric to direction.  `early`/`late` name metrics of the
    first and last third of the window.
    """

    def of(metric: str, column: str):
        return F.max(F.when(C("metric") == metric, C(column)))

    rails = []
    for name, side in guardrails.items():
        rails.append(
            F.struct(
                F.lit(name).alias("metric_name"), F.lit(side).alias("direction"),
                of(name, "ci_lower_90").alias("ci_lower_90"), of(name, "ci_upper_90").alias("ci_upper_90"),
            )
        )
    empty = F.lit(None).cast("double")
    out = effects.groupBy(*keys, arm).agg(
        of(primary, "srm_p_control").alias("srm_p"),
        F.array(*rails).alias("guardrails"),
        (of(primary, "n_control") + of(primary, "n_treatment")).alias("n_observed"),
        of(primary, "ci_lower").alias("primary_ci_lower_95"),
        of(primary, "ci_upper").alias("primary_ci_upper_95"),
        of(primary, "ci_lower_90").alias("primary_ci_lower_90"),
        of(primary, "ci_upper_90").alias("primary_ci_upper_90"),
        of(primary, "diff").alias("primary_lift_magnitude"),
        of(primary, "mean_control").alias("baseline"),
        (div(of(late, "diff"), of(early, "diff")) if early and late else empty).alias("late_ratio"),
    )
    return out.withColumns(
        {
            "srm_pass": C("srm_p") > SRM_THRESHOLD,
            "srm_verdict": F.when(C("srm_p") > SRM_PASS_P, "PASS")
            .when(C("srm_p") > SRM_THRESHOLD, "WARNING").otherwise("BLOCK"),
            "srm_override_resolved": F.lit(False),
            "n_required": F.lit(n_required).cast("long"),
            "mde_pct": F.lit(float(mde_pct)),
            "primary_direction": F.lit(direction),
        }
    )


def decide(inputs: DataFrame) -> DataFrame:
    """Verdict and confidence label beside the inputs."""
    return walk_tree(inputs).withColumn(
        "confidence",
        map_confidence(
            C("primary_ci_lower_95"), C("primary_ci_upper_95"),
            C("primary_ci_lower_90"), C("primary_ci_upper_90"), C("primary_direction"),
        ),
    )
