"""Monitoring of running experiments: three checks, worst light wins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import (
    LIGHT_OF_VERDICT, LIGHT_RANK, ON_PACE, SLOW_PACE, SRM_TREND_THRESHOLD,
)
from ..functions.columns import div, join_messages
from ..operators.guardrails import guardrail_health, worst_verdict
from ..operators.srm import srm_trend

C = F.col


def verdict_to_light(verdict: Column) -> Column:
    out = F.lit("RED")
    for v, light in LIGHT_OF_VERDICT.items():
        out = F.when(verdict == v, light).otherwise(out)
    return out


def light_rank(light: Column) -> Column:
    out = F.lit(2)
    for name, r in LIGHT_RANK.items():
        out = F.when(light == name, r).otherwise(out)
    return out


def worst_light(*lights: Column) -> Column:
    rank = F.greatest(*[light_rank(x) for x in lights]) if len(lights) > 1 else light_rank(lights[0])
    return F.when(rank == 0, "GREEN").when(rank == 1, "YELLOW").otherwise("RED")


def sample_accumulation(
    df: DataFrame,
    now: Column,
    current_n: str = "current_n",
    required_n: str = "required_n",
    daily_traffic: str = "daily_traffic",
    days_elapsed: str = "days_elapsed",
    planned_days: str | None = None,
) -> DataFrame:
    """Pace against plan on a one-row-per-experiment frame; `now` is a parameter."""
    n, need = C(current_n).cast("double"), C(required_n).cast("double")
    rate, days = C(daily_traffic).cast("double"), C(days_elapsed).cast("double")
    step = df.withColumns(
        {
            "error": F.when(need <= 0, "invalid_required_n"),
            "fraction_complete": div(n, need),
        }
    )
    valid = C("error").isNull()
    early = valid & (days.isNull() | (days < 1.0))
    running = valid & ~early
    planned = C(planned_days).cast("double") if planned_days else F.lit(None).cast("double")
    planned = F.coalesce(planned, div(need, F.when(rate > 0, rate)))
    step = step.withColumns(
        {
            "days_remaining": F.when(
                running,
                F.when(rate > 0, div(F.greatest(F.lit(0.0), need - n), rate)).otherwise(F.lit(float("inf"))),
            ),
            "expected_fraction": F.when(early, 0.0).when(
                running, F.coalesce(F.when(planned > 0, F.least(F.lit(1.0), div(days, planned))), F.lit(0.0))
            ),
        }
    )
    step = step.withColumns(
        {
            "pace_ratio": F.when(
                running,
                F.when(C("expected_fraction") > 0, div(C("fraction_complete"), C("expected_fraction"))).otherwise(1.0),
            ),
            "projected_completion": F.when(
                running & (rate > 0),
                F.to_date(F.timestamp_micros((F.unix_micros(now) + C("days_remaining") * 86_400_000_000).cast("long"))),
            ),
        }
    )
    stalled = (rate <= 0) & (n < need)
    light = (
        F.when(~valid, "RED")
        .when(early, "YELLOW")
        .when(stalled, "RED")
        .when(C("fraction_complete") >= 1.0, "GREEN")
        .when(C("pace_ratio") >= ON_PACE, "GREEN")
        .when(C("pace_ratio") >= SLOW_PACE, "YELLOW")
        .otherwise("RED")
    )
    step = step.withColumn("traffic_light", light)
    return step.withColumns(
        {
            "verdict": F.when(C("traffic_light") == "GREEN", "PASS")
            .when(C("traffic_light") == "YELLOW", "WARNING")
            .otherwise("BLOCK"),
            "internal_verdict": F.when(early, "INSUFFICIENT_DATA"),
            "on_pace": C("traffic_light") == "GREEN",
        }
    )


def accrual(df: DataFrame, keys: Sequence[str], unit: str, ts: str) -> DataFrame:
    """Units so far, days elapsed and daily traffic from first appearances.

    One row per unit first: counting units, not rows, is right for panel data.
    """
    first = df.groupBy(*keys, unit).agg(F.min(ts).alias("_f"), F.max(ts).alias("_l"))
    out = first.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("current_n"),
        F.min("_f").alias("_start"),
        F.max("_l").alias("_end"),
    )
    seconds = F.unix_micros(C("_end").cast("timestamp")) - F.unix_micros(C("_start").cast("timestamp"))
    out = out.withColumn("days_elapsed", seconds / F.lit(86_400_000_000.0))
    return out.withColumn("daily_traffic", div(C("current_n"), C("days_elapsed"))).drop("_start", "_end")


def run_monitor(
    df: DataFrame,
    keys: Sequence[str],
    unit: str,
    ts: str,
    guardrails: Mapping[str, Mapping],
    required_n: int,
    now: Column,
    arm: str = "arm",
    control: str = "control",
    srm_window: str = "1d",
    srm_threshold: float = SRM_TREND_THRESHOLD,
    alpha: float = 0.05,
    planned_days: float | None = None,
) -> DataFrame:
    """Three reductions of the event frame joined by experiment.

    Each reduction is a few rows per experiment; only those are joined.
    """
    srm = srm_trend(df, keys, ts, srm_window, arm, srm_threshold).select(
        *keys, C("verdict").alias("srm_verdict"), "first_violation", "consecutive_violations", "trend_direction"
    )
    health = guardrail_health(df, keys, guardrails, arm, control, alpha)
    rail = worst_verdict(health, keys).select(*keys, C("verdict").alias("guardrail_verdict"), "flagged_metrics")
    pace_in = accrual(df, keys, unit, ts).withColumns(
        {"required_n": F.lit(required_n), "planned_days": F.lit(planned_days).cast("double")}
    )
    pace = sample_accumulation(pace_in, now, planned_days="planned_days").select(
        *keys, C("verdict").alias("sample_verdict"), "current_n", "fraction_complete", "pace_ratio"
    )
    out = srm.join(rail, list(keys), "full").join(pace, list(keys), "full")
    return monitor_summary(out)


def monitor_summary(df: DataFrame) -> DataFrame:
    """Overall light and ordered recommendations (red ones first)."""
    verdicts = {"srm": C("srm_verdict"), "guardrail": C("guardrail_verdict"), "sample": C("sample_verdict")}
    safe = {k: F.coalesce(v, F.lit("BLOCK")) for k, v in verdicts.items()}
    messages = []
    for level, prefix in (("BLOCK", "RED"), ("WARNING", "YELLOW")):
        for name, text in (
            ("srm", "sample ratio is off; diagnose the assignment"),
            ("guardrail", "a guardrail moved the wrong way; escalate"),
            ("sample", "enrolment is behind plan; check traffic"),
        ):
            messages.append(F.when(safe[name] == level, F.lit(f"{prefix}: {text}")))
    found = join_messages(*messages)
    return df.withColumns(
        {
            "status": worst_light(*[verdict_to_light(v) for v in safe.values()]),
            "recommendations": F.when(F.size(found) > 0, found).otherwise(
                F.array(F.lit("all checks green; keep monitoring"))
            ),
        }
    )
