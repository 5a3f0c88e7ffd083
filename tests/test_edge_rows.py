"""Rows with missing values, by operator family."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from trialspark.operators.corrections import adjust_pvalues
from trialspark.operators.guardrails import guardrail_health
from trialspark.operators.logs import canonical, flatten_config
from trialspark.operators.prep import BlindedColumnError, blind_projection
from trialspark.operators.profile import content_lock, detect_mixed_timestamps, discover_roles, sample_values
from trialspark.operators.segments import late_ratio, segment_moments
from trialspark.operators.srm import srm_diagnose, srm_windows
from trialspark.plans.verdict import walk_tree
from trialspark.sources.sinks import latest_analysis

GUARD = "array<struct<metric_name:string,direction:string,ci_lower_90:double,ci_upper_90:double>>"
TREE = (
    f"id string, srm_pass boolean, srm_override_resolved boolean, guardrails {GUARD}, n_observed long, n_required long, "
    "primary_ci_lower_95 double, primary_ci_upper_95 double, primary_ci_lower_90 double, primary_ci_upper_90 double, "
    "primary_lift_magnitude double, primary_direction string, mde_pct double, baseline double, late_ratio double"
)


def clean(name, **changed):
    row = {
        "id": name, "srm_pass": True, "srm_override_resolved": False,
        "guardrails": [("latency_ms", "lower_is_better", -2.0, 1.0)], "n_observed": 20000, "n_required": 18000,
        "primary_ci_lower_95": 1.4, "primary_ci_upper_95": 5.0, "primary_ci_lower_90": 1.8, "primary_ci_upper_90": 4.6,
        "primary_lift_magnitude": 3.2, "primary_direction": "higher_is_better", "mde_pct": 2.0, "baseline": 100.0,
        "late_ratio": 0.87,
    }
    return tuple({**row, **changed}.values())


def test_missing_inputs_never_ship(spark):
    rows = [
        clean("clean"), clean("override", srm_pass=False, srm_override_resolved=None),
        clean("direction", primary_direction=None), clean("required", n_required=None),
        clean("guardrail", guardrails=[("g", "lower_is_better", None, None)]),
        clean("upper", guardrails=[("g", "higher_is_better", -1.0, None)]),
    ]
    got = {r.id: (r.verdict, r.terminal_step) for r in walk_tree(spark.createDataFrame(rows, TREE)).collect()}
    assert got == {
        "clean": ("SHIP", 7), "override": ("INVALID-SRM", 1), "direction": ("UNVERIFIABLE", 6),
        "required": ("UNVERIFIABLE", 3), "guardrail": ("UNVERIFIABLE", 2), "upper": ("UNVERIFIABLE", 2),
    }


def test_rows_without_an_arm_do_not_block(spark):
    day = datetime(2020, 1, 1)
    rows = [("e", day, a) for a in ["control", "treatment"] * 100] + [("e", day, None)]
    got = srm_windows(spark.createDataFrame(rows, "experiment_id string, ts timestamp, arm string"), ["experiment_id"], "ts")
    (row,) = got.collect()
    assert row.verdict == "PASS" and abs(row.p_value - 1) < 1e-9


def test_late_ratio_leaves_out_rows_without_time(spark):
    rows = [("e", datetime(2020, 1, 1 + d), a, v) for d in range(9) for a, v in (("control", 1.0), ("treatment", 2.0))]
    rows.append(("e", None, "treatment", 1000.0))
    df = spark.createDataFrame(rows, "experiment_id string, ts timestamp, arm string, value double")
    (row,) = late_ratio(df, ["experiment_id"], "ts").collect()
    assert abs(row.late_ratio - 1) < 1e-12


def test_corrections_skip_nan_and_keep_null_families(spark):
    rows = [("f", 0.02), ("f", 0.5), ("f", float("nan")), ("f", None), (None, 0.01), (None, 0.04)]
    df = spark.createDataFrame(rows, "family string, p_value double")
    got = adjust_pvalues(df, ["family"]).select("family", "p_value", F.round("p_adjusted", 9).alias("q")).collect()
    found = {(r.family, None if r.p_value is None or math.isnan(r.p_value) else r.p_value): r.q for r in got}
    assert len(got) == 6
    assert found == {("f", 0.02): 0.04, ("f", 0.5): 0.5, ("f", None): None, (None, 0.01): 0.02, (None, 0.04): 0.04}


def test_latest_analysis_keeps_all_metrics(spark):
    old, new = datetime(2020, 1, 1), datetime(2020, 1, 2)
    rows = [("a", "m1", old), ("a", "m1", new), ("a", "m2", new), ("b", "m1", old), (None, "m1", old)]
    df = spark.createDataFrame(rows, "experiment_id string, metric string, analyzed_at timestamp")
    got = sorted((str(r.experiment_id), r.metric, r.analyzed_at) for r in latest_analysis(df, ["experiment_id"]).collect())
    assert got == [("None", "m1", old), ("a", "m1", new), ("a", "m2", new), ("b", "m1", old)]


def test_late_ratio_keeps_arms_apart(spark):
    arms = (("control", 1.0, 1.0), ("a", 2.0, 2.0), ("b", 3.0, 2.0))
    rows = [("e", datetime(2020, 1, 1 + d), arm, x if d < 3 else y) for d in range(9) for arm, x, y in arms]
    df = spark.createDataFrame(rows, "experiment_id string, ts timestamp, arm string, value double")
    got = {r.arm: r.late_ratio for r in late_ratio(df, ["experiment_id"], "ts").collect()}
    assert got == {"a": pytest.approx(1.0), "b": pytest.approx(0.5)}


def test_guardrails_that_are_no_columns_warn(spark):
    df = spark.createDataFrame([("e", "control"), ("e", "treatment")], "experiment_id string, arm string")
    got = guardrail_health(df, ["experiment_id"], {"x": {"nim": 0.1}, "y": {"type": "binary"}}).collect()
    assert {(r.metric, r.verdict, r.error) for r in got} == {
        ("x", "WARNING", "metric_missing"), ("y", "WARNING", "metric_missing"),
    }


def test_no_arm_label_is_lost(spark):
    df = spark.range(3001).select(
        F.when(F.col("id") == 3000, "control").otherwise(F.format_string("a%05d", "id")).alias("variant"), F.col("id").cast("double").alias("paid")
    )
    row = discover_roles(df).first()
    assert row.control_value == "control" and len(row.treatment_values) == 3000
    assert row.wide_columns["variant"] > 20


def test_all_date_formats_and_whole_samples(spark):
    dates = ["2024-01-02 03:04:05", "2024-01-02", "1/2/2024", "2.1.2024", "Mon, 1 Jan 2024", "1704067200000", "1704067200", "Q1-24"]
    (row,) = detect_mixed_timestamps(spark.createDataFrame([(d,) for d in dates], "d string")).collect()
    assert row.n_formats == 8 and len(row.formats) == 8 and len(row.format_samples) == 8
    (row,) = sample_values(spark.createDataFrame([("x" * 500,)], "t string")).collect()
    assert row["sample"] == "x" * 500


def test_row_texts_do_not_clash(spark):
    df = spark.createDataFrame([("a|b", ""), ("a", "b|"), ("", "a"), (None, "a"), ("1:x", None)], "a string, b string")
    assert df.select(canonical(["a", "b"]).alias("c")).distinct().count() == 5
    locks = {content_lock(df.where(F.col("b") == x)).first().hash_sum for x in ("", "b|")}
    assert len(locks) == 2


def test_nested_configurations(spark):
    text = '{"metrics": {"primary": "x", "tags": ["a", {"n": 1.50}]}, "owner": null, "empty": {}, "on": true}'
    df = spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "id long, config string")
    got = {(r.id, r.path): r.value for r in flatten_config(df, ["id"], "config").collect()}
    assert got == {
        (1, "metrics.primary"): "x", (1, "metrics.tags[0]"): "a", (1, "metrics.tags[1].n"): "1.50",
        (1, "owner"): None, (1, "empty"): "{}", (1, "on"): "true",
    }


def test_a_renamed_arm_is_refused(spark):
    df = spark.createDataFrame([("control", 1, 2.0)], "arm string, id long, value double")
    for hidden in (df.withColumnRenamed("arm", "x"), df.where("arm = 'control'").select("id")):
        with pytest.raises(BlindedColumnError):
            blind_projection(hidden)
    assert blind_projection(df, ["id"]).columns == ["id"]


def test_a_hot_segment_level_and_wide_columns(spark):
    rows = spark.range(3000).select(
        F.lit("e").alias("experiment_id"), F.when(F.col("id") % 2 == 0, "control").otherwise("treatment").alias("arm"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("s"),
        *[(F.col("id") % (k + 2)).alias(f"s{k}") for k in range(9)], F.col("id").alias("wide"), F.col("id").cast("double").alias("value"),
    )
    segments = ["s", *[f"s{k}" for k in range(9)]]
    moments = segment_moments(rows, ["experiment_id"], segments, "value")
    plan = moments._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    want = rows.where("s = 'hot' and arm = 'control'").agg(F.count("value"), F.avg("value"), F.var_samp("value")).first()
    got = moments.where("segment = 's' and segment_value = 'hot' and arm = 'control'").first()
    assert (got.n, got["mean"], got["var"]) == (want[0], pytest.approx(want[1]), pytest.approx(want[2]))
    skipped = srm_diagnose(rows.drop("value"), ["experiment_id"]).where("reason = 'too_many_levels'").collect()
    assert [r.segment for r in skipped] == ["wide"]
    assert int(skipped[0].segment_value) == pytest.approx(3000, rel=0.1)  # a sketch
