"""Segment effects and the early/late split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import div, num
from ..session import small_side
from .corrections import adjust_pvalues
from .hypothesis import welch_from_moments
from .moments import pair_arms

C = F.col


def segment_moments(
    df: DataFrame, keys: Sequence[str], segments: Sequence[str], value: str, arm: str = "arm"
) -> DataFrame:
    """Moments per pre-registered segment level, in one scan and one shuffle.

    A row meets one cell per segment inside its task, where cells combine before
    the shuffle: what is shuffled is one row per cell and task, also for a level
    that owns a third of all rows.
    """
    levels = F.array(
        *[
            F.struct(F.lit(s).alias("segment"), C(s).cast("string").alias("segment_value"))
            for s in segments
        ]
    )
    rows = df.where(C(arm).isNotNull()).select(*keys, arm, num(value).alias("_v"), F.inline(levels))
    return (
        rows.where(C("segment_value").isNotNull() & C("_v").isNotNull())
        .groupBy(*keys, "segment", "segment_value", arm)
        .agg(
            F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.var_samp("_v").alias("var"),
            F.sum("_v").alias("total"),
        )
    )


def segment_effects(
    df: DataFrame,
    keys: Sequence[str],
    segments: Sequence[str],
    value: str = "value",
    arm: str = "arm",
    control: str = "control",
    alpha: float = 0.05,
) -> DataFrame:
    """The primary metric per segment level, Holm-adjusted over the levels."""
    cell = [*keys, "segment", "segment_value"]
    pairs = pair_arms(segment_moments(df, keys, segments, value, arm), cell, arm, control)
    tested = welch_from_moments(pairs, alpha).drop("significant")
    return adjust_pvalues(tested, list(keys), "p_value", "holm", alpha)


def late_ratio(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str = "value",
    arm: str = "arm",
    control: str = "control",
) -> DataFrame:
    """Effect in the last third of the exposure window over that in the first third.

    One row per treatment arm.  The window's ends are one row per experiment;
    rows then fall into a third, rows without a time into none.
    """
    t = F.unix_micros(C(ts).cast("timestamp")).cast("double")
    ends = df.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    pos = div(t - C("_t0"), C("_t1") - C("_t0"))
    third = F.when(pos < 1 / 3, 1).when(pos < 2 / 3, 2).when(t.isNotNull(), 3)
    v = num(value)
    marked = df.join(small_side(ends, "window-ends"), list(keys)).withColumn("_third", third)

    means = marked.where(C(arm).isNotNull()).groupBy(*keys, arm).agg(
        F.avg(F.when(C("_third") == 1, v)).alias("early"), F.avg(F.when(C("_third") == 3, v)).alias("late")
    )
    out = pair_arms(means, keys, arm, control).select(
        *keys, arm,
        (C("early_treatment") - C("early_control")).alias("early_effect"),
        (C("late_treatment") - C("late_control")).alias("late_effect"),
    )
    return out.withColumn("late_ratio", div(C("late_effect"), C("early_effect")))
