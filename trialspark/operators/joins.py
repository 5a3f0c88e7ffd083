"""The joins of the assignment x fact data model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import BROADCAST_LIMIT_BYTES, fits_broadcast


def first_exposure(
    events: DataFrame, unit: str, ts: str, predicate: str | Column, keys: Sequence[str] = ()
) -> DataFrame:
    """Earliest qualifying event per unit becomes its assignment time."""
    cond = F.expr(predicate) if isinstance(predicate, str) else predicate
    return events.where(cond).groupBy(*keys, unit).agg(F.min(ts).alias("first_exposure_at"))


def join_exposure(
    facts: DataFrame,
    assign: DataFrame,
    unit: str = "unit_id",
    ts: str = "event_at",
    horizon_days: float | None = None,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Facts of assigned units at or after first exposure (optionally within a horizon).

    Inner by design: units without facts come back in `join_units_zero_filled`,
    so the fact side is never NULL-extended.  A small assignment is broadcast.
    Otherwise both sides are shuffled once by unit, and adaptive execution cuts
    the partition of a hot unit (one may own a third of all facts) into pieces
    by the real sizes of its map outputs, each beside a copy of that partition's
    assignment.  Facts are read once, and any number of units may be hot.
    """
    right = assign.withColumnRenamed(unit, "_unit")
    on = (F.col(unit) == F.col("_unit")) & (F.col(ts) >= F.col("first_exposure_at"))
    if horizon_days is not None:
        seconds = int(horizon_days * 86400)
        on = on & (F.col(ts) < F.col("first_exposure_at") + F.make_dt_interval(secs=F.lit(seconds)))
    side = F.broadcast(right) if fits_broadcast(assign, broadcast_limit) else right
    return facts.join(side, on, "inner").drop("_unit")


def join_units_zero_filled(
    assign: DataFrame, per_unit: DataFrame, on: Sequence[str], zero: Sequence[str]
) -> DataFrame:
    """Every assigned unit; a unit without facts counts 0."""
    joined = assign.join(per_unit, list(on), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(joined.schema[c].dataType)) for c in zero})


def join_dimension(facts: DataFrame, dim: DataFrame, on: Column | str | list, how: str = "left") -> DataFrame:
    """Many-to-one lookup; broadcast only when the dimension's size is checked."""
    return facts.join(F.broadcast(dim) if fits_broadcast(dim) else dim, on, how)


def join_pre_period(
    pre: DataFrame, post: DataFrame, on: Sequence[str], covariate: str, outcome: str
) -> DataFrame:
    """Pair a unit's covariate with its outcome; `pair_complete` marks usable rows."""
    joined = post.join(pre, list(on), "inner")
    return joined.withColumn(
        "pair_complete", F.col(covariate).isNotNull() & F.col(outcome).isNotNull()
    )


def multi_arm_conflict(assign: DataFrame, keys: Sequence[str], arm: str = "arm") -> DataFrame:
    """Units seen in more than one arm.  min/max combine map-side; no distinct set."""
    return (
        assign.groupBy(*keys)
        .agg(F.min(arm).alias("arm_min"), F.max(arm).alias("arm_max"), F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("arm_min") != F.col("arm_max"))
    )


def exclude_conflicts(assign: DataFrame, keys: Sequence[str], arm: str = "arm") -> DataFrame:
    return assign.join(multi_arm_conflict(assign, keys, arm).select(*keys), list(keys), "left_anti")


def align_variants(counts: DataFrame, keys: Sequence[str], window: str, arm: str = "arm") -> DataFrame:
    """Every arm of an experiment in each of its windows; a missing one counts 0."""
    windows = counts.select(*keys, window).distinct()
    arms = counts.where(F.col(arm).isNotNull()).select(*keys, arm).distinct()
    grid = windows.join(arms, list(keys)) if keys else None
    if grid is None:
        raise ValueError("align_variants needs an experiment key")
    return (
        grid.join(counts, [*keys, window, arm], "left")
        .withColumn("n", F.coalesce(F.col("n"), F.lit(0).cast("long")))
    )
