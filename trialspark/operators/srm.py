"""Sample-ratio checks: overall, by segment, over time, and on denominators."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed_values import (
    DENOMINATOR_SRM_THRESHOLD, MAX_SEGMENT_LEVELS, SRM_PASS_P, SRM_THRESHOLD,
    SRM_TREND_DELTA, SRM_TREND_THRESHOLD,
)
from ..functions.columns import div
from ..functions.distributions import chi2_sf
from .moments import variant_counts
from .profile import low_cardinality

C = F.col


def srm_verdict(p: Column, threshold: float) -> Column:
    return (
        F.when(p > SRM_PASS_P, "PASS")
        .when(p > threshold, "WARNING")
        .otherwise("BLOCK")
    )


def _share(arm: str, expected: Mapping[str, float] | None, n_arms: Column) -> Column:
    if expected is None:
        return div(F.lit(1.0), n_arms)
    total = float(sum(expected.values()))
    share = F.lit(0.0)
    for label, weight in expected.items():
        share = F.when(C(arm) == label, F.lit(weight / total)).otherwise(share)
    return share


def srm_from_counts(
    counts: DataFrame,
    keys: Sequence[str],
    arm: str = "arm",
    expected: Mapping[str, float] | None = None,
    threshold: float = SRM_THRESHOLD,
    n_arms: str | None = None,
) -> DataFrame:
    """Chi-square goodness of fit of the arm counts of every cell.

    `n_arms` names a column with the number of arms of the experiment when some
    may be absent from the cell (an absent arm was still expected).
    """
    cell = Window.partitionBy(*keys)
    present = F.count(F.lit(1)).over(cell)
    k = F.lit(len(expected)) if expected is not None else (C(n_arms) if n_arms else present)
    cells = counts.withColumns(
        {"_total": F.sum("n").over(cell), "_k": k.cast("int"), "_present": present}
    ).withColumn("_e", C("_total") * _share(arm, expected, C("_k")))
    gap = C("n") - C("_e")
    # Arms that are absent contribute (0 - e)^2 / e = e each.
    shares = F.sum(_share(arm, expected, C("_k")))
    agg = cells.groupBy(*keys).agg(
        F.max("_total").alias("n_total"),
        F.max("_k").alias("n_arms"),
        F.sum(div(gap * gap, C("_e"))).alias("_chi"),
        shares.alias("_shares"),
    )
    missing = F.greatest(F.lit(0.0), F.lit(1.0) - C("_shares")) * C("n_total")
    out = agg.withColumn("chi2_stat", F.when(C("n_total") > 0, C("_chi") + missing))
    out = out.withColumn("p_value", chi2_sf(C("chi2_stat"), C("n_arms") - 1))
    return out.withColumns(
        {
            "verdict": srm_verdict(C("p_value"), threshold),
            "reason": F.when(C("n_total") == 0, "no_data").when(C("n_arms") < 2, "single_arm"),
        }
    ).drop("_chi", "_shares")


def srm_check(
    df: DataFrame,
    keys: Sequence[str],
    arm: str = "arm",
    expected: Mapping[str, float] | None = None,
    threshold: float = SRM_THRESHOLD,
) -> DataFrame:
    return srm_from_counts(variant_counts(df, keys, arm), keys, arm, expected, threshold)


def segment_columns(
    df: DataFrame, exclude: Sequence[str], max_levels: int = MAX_SEGMENT_LEVELS
) -> tuple[list[str], dict[str, int]]:
    """Columns with fewer than `max_levels` distinct values, and the counts of those with more."""
    few, wide = low_cardinality(df, [c for c in df.columns if c not in exclude], max_levels - 1)
    return [c for c, n in few.items() if n > 0], wide


def srm_diagnose(
    df: DataFrame,
    keys: Sequence[str],
    arm: str = "arm",
    segments: Sequence[str] | None = None,
    threshold: float = SRM_THRESHOLD,
    max_levels: int = MAX_SEGMENT_LEVELS,
) -> DataFrame:
    """SRM overall and inside each value of each segment, in one scan and one shuffle.

    A row meets one cell per segment inside its task, where counts combine
    before the shuffle.  Without `segments`, columns with fewer than
    `max_levels` values are taken; each other column is reported in a row
    without keys and verdict, with reason `too_many_levels` and its number of
    values as `segment_value`.
    """
    wide: dict[str, int] = {}
    if segments is None:
        segments, wide = segment_columns(df, [*keys, arm], max_levels)
    levels = [F.struct(F.lit("overall").alias("segment"), F.lit("all").alias("segment_value"))]
    for s in segments:
        levels.append(
            F.struct(F.lit(s).alias("segment"), C(s).cast("string").alias("segment_value"))
        )
    cells = (
        df.where(C(arm).isNotNull())
        .select(*keys, arm, F.inline(F.array(*levels)))
        .where(C("segment_value").isNotNull())
        .groupBy(*keys, "segment", "segment_value", arm)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    out = srm_from_counts(cells, [*keys, "segment", "segment_value"], arm, None, threshold)
    out = out.withColumn("flagged", C("verdict") != "PASS")
    if wide:
        rows = [(c, str(n), "too_many_levels") for c, n in wide.items()]
        skipped = df.sparkSession.createDataFrame(rows, "segment string, segment_value string, reason string")
        out = out.unionByName(skipped, allowMissingColumns=True)
    return out


_UNITS = {"h": 3600, "d": 86400, "w": 7 * 86400}


def window_seconds(window: str) -> int:
    m = re.fullmatch(r"\s*(\d*)\s*([hdwHDW])\s*", window)
    if not m:
        raise ValueError(f"window must look like '1h', '1d' or '1w', got {window!r}")
    return int(m.group(1) or 1) * _UNITS[m.group(2).lower()]


def windowed_counts(
    df: DataFrame, keys: Sequence[str], ts: str, window: str, arm: str = "arm"
) -> DataFrame:
    """Rows per window and arm; windows start at midnight of the first day.

    Counting by hour or day first makes the anchor a window function over a few
    rows instead of a second scan.
    """
    width = window_seconds(window)
    unit = "hour" if width % 86400 else "day"
    t = C(ts).cast("timestamp")
    fine = (
        df.select(*keys, arm, F.date_trunc(unit, t).alias("_t"))
        .where(C("_t").isNotNull())
        .groupBy(*keys, "_t", arm)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    secs = F.unix_seconds(C("_t"))
    day0 = F.floor(F.min(secs).over(Window.partitionBy(*keys)) / 86400) * 86400
    start = day0 + F.floor((secs - day0) / width) * width
    return (
        fine.withColumn("window_start", F.timestamp_seconds(start))
        .groupBy(*keys, "window_start", arm)
        .agg(F.sum("n").alias("n"))
    )


def srm_windows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    window: str = "1d",
    arm: str = "arm",
    threshold: float = SRM_TREND_THRESHOLD,
    expected: Mapping[str, float] | None = None,
) -> DataFrame:
    """SRM inside every populated window; an arm missing from a window counts 0."""
    counts = windowed_counts(df, keys, ts, window, arm)
    # Number of arms of the whole experiment: dense_rank counts distinct labels.
    experiment = Window.partitionBy(*keys)
    ranked = counts.withColumn(
        "_r", F.when(C(arm).isNotNull(), F.dense_rank().over(experiment.orderBy(C(arm).asc_nulls_last())))
    )
    ranked = ranked.withColumn("_arms", F.coalesce(F.max("_r").over(experiment), F.lit(0)))
    # Rows without an arm belong to no arm: they are left out, as in every SRM count.
    return srm_from_counts(
        ranked.where(C(arm).isNotNull()).drop("_r"), [*keys, "window_start"], arm, expected, threshold, n_arms="_arms"
    )


def srm_trend_from_windows(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per experiment: first violation, trailing run, direction, verdict."""
    by_time = Window.partitionBy(*keys).orderBy("window_start")
    latest_first = Window.partitionBy(*keys).orderBy(C("window_start").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    whole = Window.partitionBy(*keys)
    bad = C("verdict") != "PASS"
    marked = windows.withColumns(
        {
            "_i": F.row_number().over(by_time),
            "_n": F.count(F.lit(1)).over(whole),
            "_passed": F.sum(F.when(bad, 0).otherwise(1)).over(latest_first),
        }
    ).withColumn("_half", F.greatest(F.lit(1), F.floor(C("_n") / 2)))
    p = F.coalesce(C("p_value"), F.lit(0.0))
    first = F.sum(F.when(C("_i") <= C("_half"), p))
    last = F.sum(F.when(C("_i") > C("_n") - C("_half"), p))
    out = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.min(F.when(bad, C("window_start"))).alias("first_violation"),
        F.count(F.when(C("_passed") == 0, 1)).alias("consecutive_violations"),
        div(last - first, F.max("_half")).alias("_delta"),
        F.bool_or(C("verdict") == "BLOCK").alias("_block"),
        F.bool_or(C("verdict") == "WARNING").alias("_warn"),
    )
    return out.select(
        *keys,
        "n_windows",
        "first_violation",
        "consecutive_violations",
        F.when(C("n_windows") < 2, "stable")
        .when(C("_delta") > SRM_TREND_DELTA, "improving")
        .when(C("_delta") < -SRM_TREND_DELTA, "worsening")
        .otherwise("stable")
        .alias("trend_direction"),
        F.when(C("_block"), "BLOCK").when(C("_warn"), "WARNING").otherwise("PASS").alias("verdict"),
    )


def srm_trend(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    window: str = "1d",
    arm: str = "arm",
    threshold: float = SRM_TREND_THRESHOLD,
    expected: Mapping[str, float] | None = None,
) -> DataFrame:
    return srm_trend_from_windows(srm_windows(df, keys, ts, window, arm, threshold, expected), keys)


def denominator_srm(
    pairs: DataFrame,
    control: str = "sum_y_control",
    treatment: str = "sum_y_treatment",
    expected_ratio: float = 1.0,
    threshold: float = DENOMINATOR_SRM_THRESHOLD,
) -> DataFrame:
    """Are the denominators of a ratio metric balanced across arms?"""
    c, t = C(control).cast("double"), C(treatment).cast("double")
    total = c + t
    ec = total * expected_ratio / (1 + expected_ratio)
    et = total - ec
    out = pairs.withColumn("chi2_stat", div((c - ec) * (c - ec), ec) + div((t - et) * (t - et), et))
    out = out.withColumns(
        {"p_value": chi2_sf(C("chi2_stat"), F.lit(1)), "observed_ratio": div(c, t)}
    )
    return out.withColumn(
        "verdict",
        F.when(C("p_value") >= 2 * threshold, "PASS")
        .when(C("p_value") >= threshold, "WARNING")
        .otherwise("BLOCK"),
    )


def expected_shape_check(
    df: DataFrame,
    keys: Sequence[str],
    expected: Mapping[str, float],
    arm: str = "arm",
    tolerance: float = 0.01,
) -> DataFrame:
    """Observed arms and shares against the pre-registered shape."""
    counts = variant_counts(df, keys, arm)
    labels = F.array(*[F.lit(a) for a in expected])
    registered = counts.select(*keys).distinct().withColumn(arm, F.explode(labels))
    total = Window.partitionBy(*keys)
    joined = registered.withColumn("_reg", F.lit(True)).join(counts, [*keys, arm], "full")
    total_weight = float(sum(expected.values()))
    share = F.lit(0.0)
    for label, w in expected.items():
        share = F.when(C(arm) == label, F.lit(w / total_weight)).otherwise(share)
    out = joined.select(
        *keys,
        arm,
        F.coalesce(C("n"), F.lit(0)).alias("n"),
        F.when(C("_reg"), share).alias("expected_share"),
        F.coalesce(div(C("n"), F.sum("n").over(total)), F.lit(0.0)).alias("observed_share"),
    )
    return out.withColumn(
        "status",
        F.when(C("expected_share").isNull(), "unexpected_arm")
        .when(C("n") == 0, "missing_arm")
        .when(F.abs(C("observed_share") - C("expected_share")) > tolerance, "ratio_drift")
        .otherwise("match"),
    )
