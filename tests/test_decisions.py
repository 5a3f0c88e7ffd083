"""SRM, the verdict ladder, confidence labels, monitoring and streams."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import srm
from trialspark.plans import monitor as mon, verdict as vd

C = F.col
K = ["experiment_id"]

SCHEMA = (
    "experiment_id string, srm_pass boolean, srm_override_resolved boolean, "
    "guardrails array<struct<metric_name:string,direction:string,ci_lower_90:double,ci_upper_90:double>>, "
    "n_observed long, n_required long, primary_ci_lower_95 double, primary_ci_upper_95 double, "
    "primary_ci_lower_90 double, primary_ci_upper_90 double, primary_lift_magnitude double, "
    "primary_direction string, mde_pct double, baseline double, late_ratio double"
)
SHIP = dict(
    experiment_id="e", srm_pass=True, srm_override_resolved=False, guardrails=[("latency_ms", "lower_is_better", -2.0, 1.0)],
    n_observed=20000, n_required=18000, primary_ci_lower_95=1.4, primary_ci_upper_95=5.0, primary_ci_lower_90=1.8,
    primary_ci_upper_90=4.6, primary_lift_magnitude=3.2, primary_direction="higher_is_better", mde_pct=2.0, baseline=100.0, late_ratio=0.87,
)
FLAT = dict(primary_ci_lower_95=-1.0, primary_ci_upper_95=1.0, primary_ci_lower_90=-0.8, primary_ci_upper_90=0.8, primary_lift_magnitude=0.0)
LADDER = [
    ({}, "SHIP", 7),
    ({"mde_pct": None}, "UNVERIFIABLE", 0),
    ({"baseline": None, "srm_pass": False}, "UNVERIFIABLE", 0),
    ({"srm_pass": None}, "UNVERIFIABLE", 1),
    ({"srm_pass": False}, "INVALID-SRM", 1),
    ({"srm_pass": False, "srm_override_resolved": True}, "SHIP", 7),
    ({"guardrails": None}, "UNVERIFIABLE", 2),
    ({"guardrails": []}, "SHIP", 7),
    ({"guardrails": [("latency_ms", "lower_is_better", 0.5, 1.0)], "n_observed": None}, "NO-SHIP-GUARDRAIL", 2),
    ({"guardrails": [("rev", "higher_is_better", -3.0, -0.1)]}, "NO-SHIP-GUARDRAIL", 2),
    ({"n_observed": None}, "UNVERIFIABLE", 3),
    ({"primary_ci_lower_95": None}, "UNVERIFIABLE", 3),
    ({**FLAT, "n_observed": 100}, "INCONCLUSIVE", 3),
    ({**FLAT, "n_observed": 100, "primary_ci_lower_90": None}, "INCONCLUSIVE", 3),
    ({"n_observed": 100}, "SHIP", 7),
    ({**FLAT, "primary_ci_lower_95": -5.0, "primary_ci_upper_95": 5.0}, "NO-LIFT", 4),
    ({**FLAT, "primary_ci_lower_90": None}, "UNVERIFIABLE", 5),
    ({"primary_ci_lower_95": -0.1, "primary_ci_upper_95": 3.0, "primary_ci_lower_90": 0.2}, "DIRECTIONAL-ONLY", 5),
    ({"primary_ci_lower_95": 0.0, "primary_ci_upper_95": 3.0, "primary_ci_lower_90": 0.2}, "DIRECTIONAL-ONLY", 5),
    ({"primary_lift_magnitude": None}, "UNVERIFIABLE", 6),
    ({"primary_lift_magnitude": 0.9}, "LIFT-WITH-CAVEAT", 6),
    ({"primary_lift_magnitude": 1.0}, "SHIP", 7),
    ({"late_ratio": 0.69}, "LIFT-WITH-CAVEAT", 7),
    ({"late_ratio": 0.7}, "SHIP", 7),
    ({"late_ratio": None}, "SHIP", 7),
    (FLAT, "LEARN", 8),
    ({"primary_direction": "lower_is_better"}, "LEARN", 8),
    ({"primary_direction": "neither", "primary_ci_lower_95": -5.0, "primary_ci_upper_95": -1.0, "primary_ci_lower_90": -4.0,
      "primary_ci_upper_90": -2.0, "primary_lift_magnitude": -3.0}, "SHIP", 7),
    ({"primary_direction": "lower_is_better", "primary_ci_lower_95": -5.0, "primary_ci_upper_95": -1.0, "primary_ci_lower_90": -4.0,
      "primary_ci_upper_90": -2.0, "primary_lift_magnitude": -3.0}, "SHIP", 7),
]


def test_every_rung(spark):
    names = [p.strip().split(" ")[0] for p in SCHEMA.split(", ")]
    rows = []
    for i, (change, _, _) in enumerate(LADDER):
        row = {**SHIP, **change, "experiment_id": str(i)}
        rows.append(tuple(row[n] for n in names))
    got = {r.experiment_id: (r.verdict, r.terminal_step) for r in vd.walk_tree(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (change, verdict, step) in enumerate(LADDER):
        assert got[str(i)] == (verdict, step), change


@pytest.mark.parametrize("bounds,direction,label", [
    ((1, 3, 1.2, 2.8), "higher_is_better", "highly likely positive"),
    ((-0.1, 3, 0.1, 2.8), "higher_is_better", "very likely positive"),
    ((-3, -1, -2.8, -1.2), "higher_is_better", "highly likely negative"),
    ((-3, -1, -2.8, -1.2), "lower_is_better", "highly likely positive"),
    ((-3, -1, -2.8, -1.2), "neither", "highly likely positive"),
    ((-1, 1, -0.8, 0.8), "higher_is_better", "inconclusive"),
    ((-1, 2, -0.8, 1.8), "higher_is_better", "leaning positive"),
    ((-1, 2, -0.8, 1.8), "lower_is_better", "leaning negative"),
    ((-2, 1, -1.8, 0.8), "neither", "leaning positive"),
    ((3, 1, 2.8, 1.2), "higher_is_better", "highly likely positive"),
    ((1, 3, 1.2, 2.8), "sideways", None),
    ((None, 3, 1.2, 2.8), "neither", None),
])
def test_confidence_labels(spark, bounds, direction, label):
    row = tuple(None if b is None else float(b) for b in bounds) + (direction,)
    df = spark.createDataFrame([row], "a double, b double, c double, d double, e string")
    assert df.select(vd.map_confidence(*[C(x) for x in "abcde"]).alias("l")).first().l == label


@pytest.mark.parametrize("x,text", [(0.032, "+0.032"), (-1.4, "-1.4"), (0.0, "+0"), (123456.0, "+1.235e+05"), (0.00001234, "+1.234e-05"),
                                    (9999.96, "+1e+04"), (1234.4, "+1234"), (-0.0005, "-0.0005")])
def test_signed_numbers(spark, x, text):
    assert spark.createDataFrame([(x,)], "x double").select(vd._signed(C("x")).alias("t")).first().t == text


def arms(spark, counts, exp="e"):
    rows = [(exp, a, n) for a, n in counts.items()]
    return spark.createDataFrame(rows, "experiment_id string, arm string, n long")


@pytest.mark.parametrize("counts,verdict", [
    ({"a": 5023, "b": 4977}, "PASS"), ({"a": 5200, "b": 4800}, "BLOCK"), ({"a": 5110, "b": 4890}, "WARNING"), ({"a": 10}, "BLOCK"),
    ({"a": 100, "b": 100, "c": 100}, "PASS"),
])
def test_srm_verdicts(spark, counts, verdict):
    assert srm.srm_from_counts(arms(spark, counts), K).first().verdict == verdict


def test_srm_single_arm_reason_and_absent_expected_arm(spark):
    one = srm.srm_from_counts(arms(spark, {"a": 10}), K).first()
    assert one.reason == "single_arm" and one.p_value is None
    absent = srm.srm_from_counts(arms(spark, {"a": 10}), K, expected={"a": 1, "b": 1}).first()
    assert absent.chi2_stat == pytest.approx(10.0)


def trend(spark, days):
    rows = []
    for d, (c, t) in enumerate(days):
        rows += [("e", "c", f"2024-03-{d + 1:02d} 12:00:00")] * c + [("e", "t", f"2024-03-{d + 1:02d} 13:00:00")] * t
    df = spark.createDataFrame(rows, "experiment_id string, arm string, ts string").withColumn("ts", C("ts").cast("timestamp"))
    return srm.srm_trend(df, K, "ts").first()


def test_trend_breakage_mid_flight(spark):
    r = trend(spark, [(100, 100), (100, 100), (100, 20), (100, 0)])
    assert r.verdict == "BLOCK" and r.consecutive_violations == 2 and r.trend_direction == "worsening"
    assert str(r.first_violation) == "2024-03-03 00:00:00"


def test_trend_recovers(spark):
    r = trend(spark, [(100, 10), (100, 100), (100, 100), (100, 100)])
    assert r.consecutive_violations == 0 and r.trend_direction == "improving" and r.n_windows == 4


def test_weekly_windows_start_on_the_first_day(spark):
    rows = [("e", "c", f"2024-03-{d:02d} 23:00:00") for d in range(5, 20)]
    df = spark.createDataFrame(rows, "experiment_id string, arm string, ts string").withColumn("ts", C("ts").cast("timestamp"))
    got = sorted((str(r.window_start), r.n) for r in srm.windowed_counts(df, K, "ts", "1w").collect())
    assert got == [("2024-03-05 00:00:00", 7), ("2024-03-12 00:00:00", 7), ("2024-03-19 00:00:00", 1)]


@pytest.mark.parametrize("window", ["1m", "", "x", "1 month"])
def test_unknown_windows(window):
    with pytest.raises(ValueError):
        srm.window_seconds(window)


def pace(spark, n, need, rate, days):
    df = spark.createDataFrame([(n, need, rate, days)], "current_n long, required_n long, daily_traffic double, days_elapsed double")
    return mon.sample_accumulation(df, F.lit("2024-01-01").cast("timestamp")).first()


@pytest.mark.parametrize("args,light", [
    ((100, 0, 10.0, 5.0), "RED"), ((0, 100, 0.0, 0.5), "YELLOW"), ((50, 100, 0.0, 5.0), "RED"), ((120, 100, 10.0, 5.0), "GREEN"),
    ((50, 100, 10.0, 5.0), "GREEN"), ((30, 100, 10.0, 5.0), "YELLOW"), ((20, 100, 10.0, 5.0), "RED"),
])
def test_pace(spark, args, light):
    assert pace(spark, *args).traffic_light == light


def test_projection_uses_the_given_now(spark):
    r = pace(spark, 50, 100, 10.0, 5.0)
    assert str(r.projected_completion) == "2024-01-06" and r.days_remaining == 5.0


def test_recommendations_put_red_first(spark):
    df = spark.createDataFrame([("WARNING", "BLOCK", "PASS"), ("PASS", "PASS", "PASS")], "srm_verdict string, guardrail_verdict string, sample_verdict string")
    red, green = mon.monitor_summary(df).collect()
    assert red.status == "RED" and red.recommendations[0].startswith("RED") and red.recommendations[1].startswith("YELLOW")
    assert green.status == "GREEN" and len(green.recommendations) == 1
