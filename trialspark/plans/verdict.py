"""The verdict ladder and confidence labels as columns, one row per experiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import CENTRE_BAND, NOVELTY_FLOOR, SMALL_LIFT_FRACTION, WIDE_NULL_MULTIPLE
from ..functions.columns import div, null_string

C = F.col


def _straddles(lo: Column, hi: Column) -> Column:
    return (lo <= 0) & (hi >= 0)


def violated_guardrails(guardrails: str = "guardrails") -> Column:
    """Names of guardrails whose 90% interval lies wholly on the harm side."""
    bad = F.filter(
        C(guardrails),
        lambda g: F.when(g["direction"] == "higher_is_better", g["ci_upper_90"] < 0).otherwise(
            g["ci_lower_90"] > 0
        ),
    )
    return F.transform(bad, lambda g: g["metric_name"])


def unmeasured_guardrail(guardrails: str = "guardrails") -> Column:
    """Whether a guardrail lacks the bound its direction needs, so that it can't be called clear."""
    return F.exists(
        C(guardrails),
        lambda g: F.when(g["direction"] == "higher_is_better", g["ci_upper_90"].isNull()).otherwise(
            g["ci_lower_90"].isNull()
        ),
    )


def walk_tree(df: DataFrame) -> DataFrame:
    """Adds verdict, terminal_step, reason, mde_absolute and guardrails_violated.

    Every rung tests its own inputs for NULL before it compares, so missing data
    stops the walk there as UNVERIFIABLE, while an earlier rung that fires wins.
    """
    lo95, hi95 = C("primary_ci_lower_95"), C("primary_ci_upper_95")
    lo90, hi90 = C("primary_ci_lower_90"), C("primary_ci_upper_90")
    step = df.withColumns(
        {
            "mde_absolute": C("mde_pct") / 100 * C("baseline"),
            "guardrails_violated": violated_guardrails(),
        }
    )
    mde = C("mde_absolute")
    null95 = lo95.isNull() | hi95.isNull()
    null90 = lo90.isNull() | hi90.isNull()
    flat = _straddles(lo95, hi95)
    powered = C("n_observed") >= C("n_required")
    side = C("primary_direction")
    benefit = (
        F.when(flat, False)
        .when(side == "higher_is_better", lo95 > 0)
        .when(side == "lower_is_better", hi95 < 0)
        .otherwise(True)
    )
    lift = F.abs(C("primary_lift_magnitude"))
    small = lift < SMALL_LIFT_FRACTION * mde
    fresh = C("late_ratio") < NOVELTY_FLOOR

    rungs: list[tuple[Column, str, int, str | None]] = [
        (C("mde_pct").isNull() | C("baseline").isNull(), "UNVERIFIABLE", 0, "missing_input"),
        (C("srm_pass").isNull(), "UNVERIFIABLE", 1, "missing_input"),
        (~C("srm_pass") & ~F.coalesce(C("srm_override_resolved"), F.lit(False)), "INVALID-SRM", 1, None),
        (C("guardrails").isNull(), "UNVERIFIABLE", 2, "missing_input"),
        (F.size("guardrails_violated") > 0, "NO-SHIP-GUARDRAIL", 2, None),
        (unmeasured_guardrail(), "UNVERIFIABLE", 2, "missing_input"),
        (C("n_observed").isNull() | C("n_required").isNull() | null95, "UNVERIFIABLE", 3, "missing_input"),
        (~powered & flat, "INCONCLUSIVE", 3, None),
        (flat & powered & ((hi95 - lo95) / 2 > WIDE_NULL_MULTIPLE * mde), "NO-LIFT", 4, None),
        (null90, "UNVERIFIABLE", 5, "missing_input"),
        (flat & ~_straddles(lo90, hi90), "DIRECTIONAL-ONLY", 5, None),
        (C("primary_lift_magnitude").isNull(), "UNVERIFIABLE", 6, "missing_input"),
        (~flat & side.isNull(), "UNVERIFIABLE", 6, "missing_input"),
        (benefit & small, "LIFT-WITH-CAVEAT", 6, "small_lift"),
        (benefit & F.coalesce(fresh, F.lit(False)), "LIFT-WITH-CAVEAT", 7, "novelty"),
        (benefit & C("late_ratio").isNull(), "SHIP", 7, "late_ratio_unavailable"),
        (benefit, "SHIP", 7, None),
        (flat & powered, "LEARN", 8, "well_powered_null"),
        (flat, "LEARN", 8, "underpowered"),
    ]
    verdict = terminal = reason = None
    for cond, name, number, why in rungs:
        why_col = F.lit(why) if why else null_string()
        if verdict is None:
            verdict, terminal, reason = F.when(cond, name), F.when(cond, number), F.when(cond, why_col)
        else:
            verdict, terminal, reason = (
                verdict.when(cond, name), terminal.when(cond, number), reason.when(cond, why_col)
            )
    return step.withColumns(
        {
            "verdict": verdict.otherwise("LEARN"),
            "terminal_step": terminal.otherwise(8),
            "reason": reason.otherwise("analysis_incomplete"),
        }
    )


def map_confidence(
    lo95: Column, hi95: Column, lo90: Column, hi90: Column, direction: Column
) -> Column:
    """Seven labels from the 90% and 95% intervals, oriented by direction."""
    a95, b95 = F.least(lo95, hi95), F.greatest(lo95, hi95)
    a90, b90 = F.least(lo90, hi90), F.greatest(lo90, hi90)
    down = direction == "lower_is_better"
    o95, p95 = F.when(down, -b95).otherwise(a95), F.when(down, -a95).otherwise(b95)
    o90, p90 = F.when(down, -b90).otherwise(a90), F.when(down, -a90).otherwise(b90)
    either = direction == "neither"
    centre = (o90 + p90) / 2
    near = F.abs(centre) <= CENTRE_BAND * (p90 - o90) / 2
    known = lo95.isNotNull() & hi95.isNotNull() & lo90.isNotNull() & hi90.isNotNull()
    label = (
        F.when((o95 > 0) | (either & (p95 < 0)), "highly likely positive")
        .when((o90 > 0) | (either & (p90 < 0)), "very likely positive")
        .when(p95 < 0, "highly likely negative")
        .when(p90 < 0, "very likely negative")
        .when(near, "inconclusive")
        .when(either | (centre > 0), "leaning positive")
        .otherwise("leaning negative")
    )
    return F.when(
        known & direction.isin("higher_is_better", "lower_is_better", "neither"), label
    )


def verdict_replay(reports: DataFrame) -> DataFrame:
    """Recompute stored verdicts; NULL means the stored inputs cannot be checked."""
    walked = walk_tree(
        reports.withColumnsRenamed({"verdict": "stored_verdict", "terminal_step": "stored_step"})
    )
    missing = F.lit(False)
    for c in ("srm_override_resolved", "n_observed", "n_required", "primary_direction", "mde_pct", "baseline"):
        missing = missing | C(c).isNull()
    vague = F.exists(
        "guardrails",
        lambda g: ~F.coalesce(g["direction"].isin("higher_is_better", "lower_is_better"), F.lit(False)),
    )
    same = (C("verdict") == C("stored_verdict")) & (C("terminal_step") == C("stored_step"))
    return walked.withColumn(
        "reproduces", F.when(missing | F.coalesce(vague, F.lit(False)), F.lit(None)).otherwise(same)
    )


def render_status(df: DataFrame, live_hash: str, stored_hash: str, reproduces: str = "reproduces") -> DataFrame:
    """VERIFIED / DRAFT_UNVERIFIED / UNVERIFIABLE, with the first failing check."""
    hash_ok = C(live_hash) == C(stored_hash)
    cannot = C(live_hash).isNull() | C(stored_hash).isNull()
    return df.withColumns(
        {
            "render_status": F.when(cannot | C(reproduces).isNull(), "UNVERIFIABLE")
            .when(hash_ok & C(reproduces), "VERIFIED")
            .otherwise("DRAFT_UNVERIFIED"),
            "status_reason": F.when(cannot, "hash_missing")
            .when(C(reproduces).isNull(), "inputs_incomplete")
            .when(~hash_ok, "hash_mismatch")
            .when(~C(reproduces), "verdict_mismatch"),
        }
    )


FLAGS = [
    "underpowered", "srm_violation", "mixed_results", "guardrail_violation", "novelty_effect",
    "simpsons_paradox",
]


def edge_case_flags(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form (keys, name, status) from one row of findings per experiment.

    Expects n_observed, n_required, srm_pass, guardrails_violated, late_ratio,
    primary_effect, effect_signs (array of -1/0/1 per secondary metric) and
    segment_signs (array of -1/0/1 per segment level).
    """
    sign = F.signum(C("primary_effect"))

    def status(cond: Column, level: str = "flagged") -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), level).otherwise("clear")

    opposite = F.exists("effect_signs", lambda s: s * sign < 0)
    reversed_everywhere = (F.size("segment_signs") > 0) & F.forall("segment_signs", lambda s: s * sign < 0)
    by_name = {
        "underpowered": status(C("n_observed") < C("n_required")),
        "srm_violation": status(~C("srm_pass"), "blocking"),
        "mixed_results": status(opposite),
        "guardrail_violation": status(F.size("guardrails_violated") > 0, "blocking"),
        "novelty_effect": status(C("late_ratio") < NOVELTY_FLOOR),
        "simpsons_paradox": status(reversed_everywhere),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("name"), by_name[n].alias("status")) for n in FLAGS])
    return df.select(*keys, F.inline(rows))


def _signed(x: Column) -> Column:
    """Signed, four significant digits, without trailing zeros."""
    return F.format_string("%s%s", F.when(x < 0, "-").otherwise("+"), significant(F.abs(x), 4))


def significant(x: Column, digits: int) -> Column:
    """Shortest plain form of a non-negative number at so many significant digits.

    Numbers of 1e`digits` and more, or below 1e-4, use exponent notation.
    """
    exp = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(x))).cast("int")
    scaled = F.round(x / F.pow(F.lit(10.0), exp), digits - 1)
    exp = F.when(scaled >= 10, exp + 1).otherwise(exp)
    scaled = F.when(scaled >= 10, scaled / 10).otherwise(scaled)
    mantissa = F.regexp_replace(
        F.regexp_replace(F.format_number(scaled, digits - 1), F.lit("0+$"), F.lit("")), F.lit(r"\.$"), F.lit("")
    )
    scientific = F.format_string(
        "%se%s%02d", mantissa, F.when(exp < 0, "-").otherwise("+"), F.abs(exp)
    )
    plain = F.regexp_replace(F.format_string("%.12f", F.round(scaled * F.pow(F.lit(10.0), exp), 12)), F.lit("0+$"), F.lit(""))
    plain = F.regexp_replace(plain, F.lit(r"\.$"), F.lit(""))
    return F.when(x.isNull(), null_string()).when((exp >= digits) | (exp < -4), scientific).otherwise(plain)


def report_metric_table(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary, guardrails, controls and segments as printable rows.

    Expects role (primary|guardrail|control|segment), name, direction, diff,
    lift_pct, four interval bounds and verdict.  Nothing is re-derived.
    """
    name = F.when(C("role") == "segment", F.concat(C("name"), F.lit(" (segment)"))).otherwise(C("name"))
    status = (
        F.when(C("role") == "primary", C("verdict")).when(C("role") == "segment", "segment").otherwise("clear")
    )
    directions = ["higher_is_better", "lower_is_better", "neither"]

    def interval(lo: str, hi: str) -> Column:
        return F.concat(F.lit("["), _signed(C(lo)), F.lit(", "), _signed(C(hi)), F.lit("]"))

    return results.select(
        *keys,
        name.alias("name"),
        F.when(C("direction").isin(directions), C("direction")).otherwise("neither").alias("direction"),
        F.concat(_signed(C("diff")), F.lit(" ("), F.format_string("%+.1f", C("lift_pct")), F.lit("%)")).alias("lift"),
        interval("ci_lower_95", "ci_upper_95").alias("ci_95"),
        interval("ci_lower_90", "ci_upper_90").alias("ci_90"),
        status.alias("status"),
    )


def sample_percent(observed: Column, required: Column) -> Column:
    """Observed against required as a whole percent; NULL when either is missing or zero."""
    return F.when(required != 0, F.bround(div(observed, required) * 100, 0).cast("int"))
