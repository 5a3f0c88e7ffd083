"""Reduce rows to a moments frame: one row per cell and arm.

Everything downstream (tests, monitors, verdicts) is arithmetic on these few
rows, so the raw data is scanned once and shuffled once, with map-side partial
aggregates: a cell that owns a third of all rows still ships one partial row
per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import num


def _value(value: str | Column) -> Column:
    return num(value)


def variant_counts(df: DataFrame, keys: Sequence[str], arm: str = "arm") -> DataFrame:
    """Rows per arm and cell."""
    return df.where(F.col(arm).isNotNull()).groupBy(*keys, arm).agg(F.count(F.lit(1)).alias("n"))


def distinct_arms(df: DataFrame, keys: Sequence[str], arm: str = "arm") -> DataFrame:
    """Sorted arm labels per cell (arms are few; the set is deduplicated map-side)."""
    return (
        df.where(F.col(arm).isNotNull())
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_set(arm)).alias("arms"))
    )


def arm_moments(
    df: DataFrame, keys: Sequence[str], value: str | Column = "value", arm: str = "arm"
) -> DataFrame:
    """n, mean, sample variance and total of one value per cell and arm."""
    v = _value(value)
    return (
        df.where(F.col(arm).isNotNull())
        .groupBy(*keys, arm)
        .agg(
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.var_samp(v).alias("var"),
            F.sum(v).alias("total"),
        )
    )


def metric_moments(
    df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str | Column], arm: str = "arm"
) -> DataFrame:
    """`arm_moments` for many metrics in one scan; long form with a `metric` column.

    `units` counts the rows of the arm, whether or not they have a value of the
    metric; `n` counts those that do.

    The aggregate is wide (one row per cell and arm); only its result is turned
    into rows, so the cost per extra metric is a few more aggregate buffers.
    """
    aggs = []
    for name, value in metrics.items():
        v = _value(value)
        aggs.append(
            F.struct(
                F.lit(name).alias("metric"),
                F.count(v).alias("n"),
                F.avg(v).alias("mean"),
                F.var_samp(v).alias("var"),
                F.sum(v).alias("total"),
            )
        )
    wide = (
        df.where(F.col(arm).isNotNull())
        .groupBy(*keys, arm)
        .agg(F.array(*aggs).alias("m"), F.count(F.lit(1)).alias("units"))
    )
    return wide.select(*keys, arm, "units", F.inline("m"))


def pair_moments(
    df: DataFrame,
    keys: Sequence[str],
    x: str | Column,
    y: str | Column,
    arm: str = "arm",
    drop_incomplete: bool = True,
) -> DataFrame:
    """Joint moments of two values per cell and arm, over complete pairs.

    `n_incomplete` counts the rows in which either side is missing.
    """
    vx, vy = _value(x), _value(y)
    both = vx.isNotNull() & vy.isNotNull()
    px, py = F.when(both, vx), F.when(both, vy)
    return (
        df.where(F.col(arm).isNotNull())
        .groupBy(*keys, arm)
        .agg(
            F.count(F.when(both, 1)).alias("n"),
            F.count(F.when(~both, 1)).alias("n_incomplete"),
            F.avg(px).alias("mean_x"),
            F.avg(py).alias("mean_y"),
            F.var_samp(px).alias("var_x"),
            F.var_samp(py).alias("var_y"),
            F.covar_samp(px, py).alias("cov"),
            F.sum(px).alias("sum_x"),
            F.sum(py).alias("sum_y"),
            F.bool_and(F.when(both, vx == vy)).alias("identical"),
        )
    )


def pair_arms(
    moments: DataFrame, keys: Sequence[str], arm: str = "arm", control: str = "control"
) -> DataFrame:
    """Put the control row of a cell beside each of its other arms.

    A window over the reduced frame instead of a self-join: the aggregate below
    is planned once.  Statistics get the suffixes `_control` and `_treatment`;
    `arm` keeps the treatment label.  A cell without control has NULL control
    statistics and is reported, not lost.
    """
    stats = [c for c in moments.columns if c not in {*keys, arm}]
    cell = Window.partitionBy(*keys)
    row = F.struct(*[F.col(c) for c in stats])
    joined = moments.withColumn(
        "_control", F.max(F.when(F.col(arm) == control, row)).over(cell)
    ).where(F.col(arm) != control)
    return joined.select(
        *keys,
        arm,
        *[F.col("_control")[c].alias(f"{c}_control") for c in stats],
        *[F.col(c).alias(f"{c}_treatment") for c in stats],
    )
