"""One mergeable rollup per unit and day that monitoring and looks read instead of events.

Events are scanned once, when their day is rolled up; later days are merged in.
Tests on it compare units, never event rows, so a busy unit counts once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import MSPRT_MIN_N, SRM_TREND_THRESHOLD
from ..functions.columns import div, num
from ..operators.guardrails import guardrail_health, worst_verdict
from ..operators.moments import pair_arms
from ..operators.quantiles import with_group
from ..operators.sequential import complete_looks, msprt_test
from ..operators.srm import srm_trend
from ..session import materialize
from .monitor import monitor_summary, sample_accumulation

C = F.col
FOLDS = ("sum", "mean", "any")


def unit_days(
    events: DataFrame, keys: Sequence[str], values: Sequence[str], unit: str = "unit_id", ts: str = "event_at", arm: str = "arm"
) -> DataFrame:
    """One row per experiment, unit, arm and day: rows, first and last time, and each value's count and sum.

    Rows without a unit or a time belong to no unit or day and are left out;
    NULL keys and NULL arms are groups of their own.  Sums combine map-side.
    """
    clash = sorted({"day", "first_at", "last_at", "n_rows"} & {*keys, unit, arm, *values})
    if clash:
        raise ValueError(f"columns {clash} have the names of rollup columns")
    at = C(ts).cast("timestamp")
    sums = [c for v in values for c in (F.count(num(v)).alias(f"{v}__n"), F.sum(num(v)).alias(f"{v}__sum"))]
    return (
        events.where(C(unit).isNotNull() & at.isNotNull())
        .groupBy(*keys, unit, arm, F.to_date(at).alias("day"))
        .agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n_rows"), *sums)
    )


def merge_unit_days(parts: Sequence[DataFrame], keys: Sequence[str], unit: str = "unit_id", arm: str = "arm") -> DataFrame:
    """Rollups of disjoint sets of events as one, as if their events had been rolled up together."""
    if not parts:
        raise ValueError("nothing to merge")
    every = reduce(DataFrame.unionByName, parts)
    fixed = [*keys, unit, arm, "day"]
    folds = {"first_at": F.min, "last_at": F.max}
    return every.groupBy(*fixed).agg(*[folds.get(c, F.sum)(c).alias(c) for c in every.columns if c not in fixed])


def unit_values(
    rollup: DataFrame, keys: Sequence[str], folds: Mapping[str, str], unit: str = "unit_id", arm: str = "arm"
) -> DataFrame:
    """One row per unit: arm, first and last time, and its values.

    A value is the unit's sum, its mean over rows, or whether its sum is above
    0 (`any`).  A unit without values has a sum of 0 and no mean.  A unit seen
    in several arms has `conflict` set and no arm, so no comparison takes it;
    rows without an arm don't make a conflict.
    """
    bad = {f for f in folds.values()} - set(FOLDS)
    if bad:
        raise ValueError(f"unknown folds {sorted(bad)}; known: {FOLDS}")
    made = []
    for name, fold in folds.items():
        total, n = F.coalesce(F.sum(f"{name}__sum"), F.lit(0.0)), F.sum(f"{name}__n")
        value = {"sum": total, "mean": div(total, F.when(n > 0, n)), "any": F.when(total > 0, 1.0).otherwise(0.0)}[fold]
        made.append(value.alias(name))
    out = rollup.groupBy(*keys, unit).agg(
        F.min(arm).alias("_lo"), F.max(arm).alias("_hi"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), *made
    )
    conflict = F.coalesce(C("_lo") != C("_hi"), F.lit(False))
    return out.withColumns({"conflict": conflict, arm: F.when(~conflict, C("_lo"))}).drop("_lo", "_hi")


def monitor_units(
    rollup: DataFrame,
    keys: Sequence[str],
    guardrails: Mapping[str, Mapping],
    required_n: int,
    now: Column,
    unit: str = "unit_id",
    arm: str = "arm",
    control: str = "control",
    srm_window: str = "1d",
    srm_threshold: float = SRM_TREND_THRESHOLD,
    alpha: float = 0.05,
    planned_days: float | None = None,
    current_n: Column | None = None,
) -> DataFrame:
    """The three checks on units: sample ratio by first appearance, guardrails, enrolment.

    A guardrail's `fold` says how a unit's rows make its value (`sum` if not
    given).  `current_n` replaces the number of units, as a column over the
    keys and `n_units`.  The unit frame is stored once and read by all three;
    events are not read.  `checked_at` is `now`, so results can be appended to a history.
    """
    folds = {m: spec.get("fold", "sum") for m, spec in guardrails.items() if f"{m}__sum" in rollup.columns}
    units = materialize(unit_values(rollup, keys, folds, unit, arm), "monitored-units")
    srm = srm_trend(units, keys, "first_at", srm_window, arm, srm_threshold).select(
        *keys, C("verdict").alias("srm_verdict"), "first_violation", "consecutive_violations", "trend_direction"
    )
    health = guardrail_health(units, keys, guardrails, arm, control, alpha)
    rail = worst_verdict(health, keys).select(*keys, C("verdict").alias("guardrail_verdict"), "flagged_metrics")
    span = F.unix_micros(F.max("last_at")) - F.unix_micros(F.min("first_at"))
    paced = units.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_units"), F.count_if("conflict").alias("n_conflicts"), (span / F.lit(86_400_000_000.0)).alias("days_elapsed")
    )
    paced = paced.withColumn("current_n", C("n_units") if current_n is None else current_n).withColumns({
        "daily_traffic": div(C("current_n"), C("days_elapsed")),
        "required_n": F.lit(required_n), "planned_days": F.lit(planned_days).cast("double"),
    })
    pace = sample_accumulation(paced, now, planned_days="planned_days").select(
        *keys, C("verdict").alias("sample_verdict"), "n_units", "n_conflicts", "current_n", "fraction_complete", "pace_ratio"
    )
    # Every experiment has units, so the paced frame has them all; NULL keys meet NULL keys.
    out = _beside(_beside(pace, srm, keys), rail, keys)
    return monitor_summary(out).withColumn("checked_at", now)


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join of two reduced frames in which NULL keys are equal."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [C(k).eqNullSafe(C(f"_r_{k}")) for k in keys])
    return left.join(other, on, "left").drop(*[f"_r_{k}" for k in keys])


def unit_look_stats(
    rollup: DataFrame, keys: Sequence[str], value: str, unit: str = "unit_id", arm: str = "arm"
) -> DataFrame:
    """n, mean, variance and total of units' sums so far, per arm at every day with news.

    A unit's day changes its arm's sums by (new total)^2 - (old total)^2, both
    centred on the arm's mean, so no look goes over earlier rows again.  The
    window runs over one unit's days; what runs over days is reduced by then.
    """
    of_unit = Window.partitionBy(*keys, unit)
    so_far = of_unit.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = (
        rollup.where(C(arm).isNotNull())
        .withColumns({"_lo": F.min(arm).over(of_unit), "_hi": F.max(arm).over(of_unit)})
        .where(C("_lo") == C("_hi"))
        .withColumn("_v", F.coalesce(C(f"{value}__sum"), F.lit(0.0)))
        .withColumns({"_total": F.sum("_v").over(so_far), "_new": F.when(F.row_number().over(of_unit.orderBy("day")) == 1, 1).otherwise(0)})
        .select(*keys, arm, "day", "_v", "_total", "_new")
    )
    cell = [*keys, arm]
    centres = steps.groupBy(*cell).agg(div(F.sum("_v"), F.sum("_new")).alias("_c"))
    now, before = C("_total") - C("_c"), C("_total") - C("_v") - C("_c")
    daily = with_group(steps, centres, cell, ["_c"]).groupBy(*cell, "day").agg(
        F.sum("_new").alias("_dn"), F.max("_c").alias("_c"),
        F.sum(F.when(C("_new") == 1, now).otherwise(now - before)).alias("_d1"),
        F.sum(F.when(C("_new") == 1, now * now).otherwise(now * now - before * before)).alias("_d2"),
    )
    running = Window.partitionBy(*cell).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = daily.withColumns({"n": F.sum("_dn").over(running), "_s1": F.sum("_d1").over(running), "_s2": F.sum("_d2").over(running)})
    shift = div(C("_s1"), C("n"))
    return sums.select(
        *keys, C("day"), arm, "n", (C("_c") + shift).alias("mean"),
        F.when(C("n") > 1, F.greatest(F.lit(0.0), div(C("_s2") - C("_s1") * shift, C("n") - 1))).alias("var"),
        (C("_c") * C("n") + C("_s1")).alias("total"),
    )


def sequential_units(
    rollup: DataFrame,
    keys: Sequence[str],
    value: str,
    unit: str = "unit_id",
    arm: str = "arm",
    control: str = "control",
    alpha: float = 0.05,
    min_n: int = MSPRT_MIN_N,
) -> DataFrame:
    """The always-valid interval on units' sums at every day, and the first day that stops."""
    stats = complete_looks(unit_look_stats(rollup, keys, value, unit, arm), keys, "day", arm)
    pairs = pair_arms(stats, [*keys, "day"], arm, control).where(C("n_control").isNotNull())
    cell = Window.partitionBy(*keys, arm)
    return msprt_test(pairs, alpha, None, min_n).withColumns({
        "look_no": F.row_number().over(cell.orderBy("day")),
        "first_stop": F.min(F.when(C("decision") == "STOP_REJECT", C("day"))).over(cell),
    })
