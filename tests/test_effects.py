"""Known answers and metamorphic checks of the two-sample tests."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import bayes, corrections, cuped, hypothesis as hy, moments as mom
from trialspark.operators import guardrails, planning, segments, sequential as sq
from trialspark.operators.exact import fisher_p, fishers_exact_test

C = F.col
K = ["experiment_id"]


def frame(spark, control, treatment, exp="e"):
    rows = [(exp, "control", float(v)) for v in control] + [(exp, "treatment", float(v)) for v in treatment]
    return spark.createDataFrame(rows, "experiment_id string, arm string, value double")


def counts(spark, rows):
    return spark.createDataFrame(
        [(f"e{i}", "treatment", *r) for i, r in enumerate(rows)],
        "experiment_id string, arm string, total_control long, n_control long, total_treatment long, n_treatment long",
    ).withColumns({"total_control": C("total_control").cast("double"), "total_treatment": C("total_treatment").cast("double")})


def test_welch_needs_variance(spark):
    r = hy.welch_test(frame(spark, [0] * 4, [1] * 4), K).first()
    assert r.error == "zero_variance" and r.p_value is None and r["diff"] == 1.0


def test_welch_needs_two_rows(spark):
    r = hy.welch_test(frame(spark, [1.0], [1.0, 2.0]), K).first()
    assert r.error == "insufficient_data" and r.p_value is None


def test_welch_against_direct_formula(spark):
    rng = np.random.default_rng(42)
    c, t = rng.normal(50, 20, 300), rng.normal(55, 25, 200)
    r = hy.welch_test(frame(spark, c, t), K).first()
    vc, vt = c.var(ddof=1) / 300, t.var(ddof=1) / 200
    se = math.sqrt(vc + vt)
    assert r.se == pytest.approx(se)
    assert r.t_stat == pytest.approx((t.mean() - c.mean()) / se)
    assert r.df == pytest.approx((vc + vt) ** 2 / (vc**2 / 299 + vt**2 / 199))
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution(r.df)
    assert r.p_value == pytest.approx(2 * dist.cumulativeProbability(-abs(r.t_stat)), rel=1e-9)
    assert math.copysign(1, r.t_stat) == math.copysign(1, r["diff"])


def test_nan_rows_do_not_count(spark):
    r = hy.welch_test(frame(spark, [1, 2, 3, float("nan")], [2, 3, 4]), K).first()
    assert r.n_control == 3 and r.error is None


def test_partition_invariance(spark):
    rng = np.random.default_rng(7)
    df = frame(spark, rng.normal(0, 1, 500), rng.normal(0.1, 1, 500))
    one, many = (hy.welch_test(df.repartition(n), K).first() for n in (1, 16))
    for name in ("t_stat", "p_value", "ci_lower", "ci_upper"):
        assert one[name] == pytest.approx(many[name], rel=1e-12)


def test_proportion_known_lift(spark):
    r = hy.proportion_from_counts(counts(spark, [(100, 1000, 120, 1000)])).first()
    assert r.lift_pct == pytest.approx(20.0)
    assert 0.1 < r.p_value < 0.2


def test_proportion_degenerate(spark):
    same, empty = sorted(
        hy.proportion_from_counts(counts(spark, [(0, 100, 0, 100), (0, 0, 1, 10)])).collect(), key=lambda r: r.experiment_id
    )
    assert same.z_stat == 0 and same.p_value == 1 and math.isinf(same.lift_pct)
    assert empty.error == "insufficient_data" and empty.p_value is None


def test_swapping_arms_flips_the_sign(spark):
    rows = hy.proportion_from_counts(counts(spark, [(100, 1000, 130, 1000), (130, 1000, 100, 1000)])).orderBy("experiment_id").collect()
    assert rows[0].z_stat == pytest.approx(-rows[1].z_stat)
    assert rows[0].p_value == pytest.approx(rows[1].p_value)


def test_many_arms_and_missing_control(spark):
    rows = [("e", a, v) for a in ("control", "b", "c") for v in (1.0, 2.0, 4.0)] + [("f", "b", 1.0), ("f", "b", 2.0)]
    df = spark.createDataFrame(rows, "experiment_id string, arm string, value double")
    out = {(r.experiment_id, r.arm): r for r in hy.welch_test(df, K).collect()}
    assert set(out) == {("e", "b"), ("e", "c"), ("f", "b")}
    assert out["f", "b"].error == "insufficient_data"


def test_ratio_equals_delta_method(spark):
    rng = np.random.default_rng(3)
    rows, parts = [], {}
    for arm, rate in (("control", 5.0), ("treatment", 5.5)):
        den = rng.poisson(4, 400) + 1
        num = den * rate + rng.normal(0, 2, 400)
        parts[arm] = (num, den)
        rows += [("e", arm, float(a), float(b)) for a, b in zip(num, den)]
    df = spark.createDataFrame(rows, "experiment_id string, arm string, numerator double, denominator double")
    r = hy.ratio_metric_test(df, K).first()

    def var(num, den):
        ratio = num.sum() / den.sum()
        return np.var(num - ratio * den, ddof=1) / den.mean() ** 2 / len(den)

    assert r.se == pytest.approx(math.sqrt(sum(var(*parts[a]) for a in parts)), rel=1e-9)


def test_cuped_exact_line(spark):
    rows = [("e", "control" if i % 2 else "treatment", float(i), 2.0 * i + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "experiment_id string, arm string, pre_value double, value double")
    v = cuped.variance_reduction(df, K, "pre_value", "value").first()
    assert v.theta == pytest.approx(2) and v.correlation == pytest.approx(1) and v.variance_reduction_pct == pytest.approx(100)


def test_cuped_rejects_identical_columns(spark):
    rows = [("e", "control" if i % 2 else "treatment", float(i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "experiment_id string, arm string, pre_value double, value double")
    assert cuped.pooled_regression(df, K, "pre_value", "value").first().error == "identical_pre_post"
    assert cuped.cuped_welch_test(df, K).first().error == "identical_pre_post"


def test_cuped_moments_equal_two_pass(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(10, 3, 600)
    y = 0.7 * x + rng.normal(0, 1, 600)
    arm = ["control" if i % 2 else "treatment" for i in range(600)]
    df = spark.createDataFrame(
        [("e", a, float(p), float(q)) for a, p, q in zip(arm, x, y)], "experiment_id string, arm string, pre_value double, value double"
    )
    direct = hy.welch_test(cuped.cuped_adjust(df, K, "pre_value", "value"), K, "adjusted").first()
    moments = cuped.cuped_welch_test(df, K).first()
    for name in ("diff", "se", "df", "p_value"):
        assert moments[name] == pytest.approx(direct[name], rel=1e-9)
    assert moments.realized_reduction_pct > 50


def test_fisher_against_enumeration(spark):
    def brute(cs, cn, ts, tn):
        total, good = cn + tn, cs + ts
        pmf = {k: math.comb(good, k) * math.comb(total - good, tn - k) / math.comb(total, tn)
               for k in range(max(0, tn - (total - good)), min(good, tn) + 1)}
        return sum(p for p in pmf.values() if p <= pmf[ts] * (1 + 1e-7))

    for case in [(1, 10, 7, 12), (0, 5, 5, 5), (3, 40, 9, 35), (2, 2, 0, 9), (50, 400, 77, 380)]:
        assert fisher_p(*case) == pytest.approx(brute(*case), rel=1e-9)
    r = fishers_exact_test(counts(spark, [(1, 10, 7, 12)])).first()
    assert r.p_value == pytest.approx(brute(1, 10, 7, 12), rel=1e-9)
    assert r.odds_ratio == pytest.approx((7.5 * 9.5) / (5.5 * 1.5))


def test_fisher_one_sided_sums_to_more_than_one():
    up, down = fisher_p(3, 20, 9, 25, "greater"), fisher_p(3, 20, 9, 25, "less")
    assert 1 < up + down < 2 and up < 0.5


def test_fisher_large_counts_stay_fast():
    assert 0 <= fisher_p(500_000, 1_000_000, 501_000, 1_000_000) < 0.5


def brute_adjust(ps, method):
    m = len(ps)
    order = sorted(range(m), key=lambda i: ps[i])
    out = [0.0] * m
    if method == "bonferroni":
        return [min(1.0, p * m) for p in ps]
    if method == "holm":
        best = 0.0
        for rank, i in enumerate(order):
            best = max(best, (m - rank) * ps[i])
            out[i] = min(1.0, best)
        return out
    best = 1.0
    for rank in range(m - 1, -1, -1):
        i = order[rank]
        best = min(best, ps[i] * m / (rank + 1))
        out[i] = best
    return out


@pytest.mark.parametrize("method", ["holm", "bonferroni", "fdr_bh"])
def test_corrections_match_brute_force(spark, method):
    rng = np.random.default_rng(5)
    families = {
        "mixed": rng.uniform(0, 1, 60).tolist() + [0.0, 1.0, 1.0, 0.5, 0.5],
        "tiny": [1e-12, 3e-9, 3e-9, 1e-4, 2e-3, 0.003, 0.0039, 0.00391],
        "tied": [0.04] * 30 + [0.2],
        "single": [0.03],
    }
    rows = [(f, i, p) for f, ps in families.items() for i, p in enumerate(ps)] + [("mixed", 999, None)]
    df = spark.createDataFrame(rows, "family string, test int, p_value double")
    got = {(r.family, r.test): r.p_adjusted for r in corrections.adjust_pvalues(df, ["family"], "p_value", method).collect()}
    assert got["mixed", 999] is None and len(got) == len(rows)
    for f, ps in families.items():
        for i, want in enumerate(brute_adjust(ps, method)):
            assert got[f, i] == pytest.approx(want, rel=1e-12), (f, i)


def test_segment_moments_equal_direct(spark):
    rng = np.random.default_rng(9)
    rows = [("e", "control" if i % 2 else "treatment", f"s{i % 3}", f"r{i % 5}", float(v)) for i, v in enumerate(rng.normal(1e6, 3, 400))]
    df = spark.createDataFrame(rows, "experiment_id string, arm string, s string, r string, value double")
    got = {(r.segment, r.segment_value, r.arm): r for r in segments.segment_moments(df, K, ["s", "r"], "value").collect()}
    want = df.groupBy("r", "arm").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect()
    for w in want:
        g = got["r", w.r, w.arm]
        assert g.mean == pytest.approx(w.m, rel=1e-12) and g["var"] == pytest.approx(w.v, rel=1e-6)


# --- sequential, Bayes, planning ---------------------------------------------------

def test_always_valid_interval_is_wider(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, rng.normal(0, 1, 400), rng.normal(0.2, 1, 400))
    pairs = mom.pair_arms(mom.arm_moments(df, K), K)
    fixed, always = hy.welch_from_moments(pairs).first(), sq.msprt_test(pairs).first()
    assert always.av_ci_lower < fixed.ci_lower and always.av_ci_upper > fixed.ci_upper


def test_peeking_keeps_the_error_rate(spark):
    """A/A experiments looked at every day rarely stop."""
    rng = np.random.default_rng(17)
    rows = [(f"e{e}", day, "control" if i % 2 else "treatment", float(v))
            for e in range(120) for day in range(8) for i, v in enumerate(rng.normal(0, 1, 24))]
    df = spark.createDataFrame(rows, "experiment_id string, look int, arm string, value double")
    path = sq.sequential_path(df, K, "look", min_n=30)
    stopped = path.where("first_stop IS NOT NULL").select("experiment_id").distinct().count()
    assert stopped / 120 <= 0.05 + 0.02


def test_no_stop_before_min_n(spark):
    df = frame(spark, [0.0, 0.1] * 5, [9.0, 9.1] * 5)
    pairs = mom.pair_arms(mom.arm_moments(df, K), K)
    r = sq.msprt_test(pairs).first()
    assert r.excludes_zero and r.decision == "CONTINUE"


def test_cumulative_stats_are_stable_far_from_zero(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(1e8, 1, 300)
    rows = [("e", i // 50, "control", float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "experiment_id string, look int, arm string, value double")
    last = sq.cumulative_sufficient_stats(df, K, "look").orderBy(C("look").desc()).first()
    assert last["var"] == pytest.approx(values.var(ddof=1), rel=1e-6)


@pytest.mark.parametrize("spending", ["obrien_fleming", "pocock"])
def test_spending_uses_all_alpha(spark, spending):
    df = spark.range(1, 6).select(C("id").alias("k"), F.lit(5).alias("n"))
    rows = sq.group_sequential_boundaries(df, "k", "n", 0.05, spending).orderBy("k").collect()
    assert rows[-1].cumulative_alpha == pytest.approx(0.05)
    assert sum(r.incremental_alpha for r in rows) == pytest.approx(0.05)
    if spending == "obrien_fleming":
        assert rows[0].z_boundary > rows[-1].z_boundary


def test_jeffreys_prior(spark):
    p = bayes.beta_binomial_posterior(counts(spark, [(50, 100, 55, 100)]), 0.5, 0.5).first()
    assert p.posterior_mean_control == pytest.approx(50.5 / 101)
    assert p.posterior_mean_treatment == pytest.approx(55.5 / 101)


def exact_beta_win(a1, b1, a2, b2):
    """P(Beta(a2,b2) > Beta(a1,b1)) as a finite sum for whole a2."""
    def lb(a, b):
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    return sum(math.exp(lb(a1 + i, b1 + b2) - math.log(b2 + i) - lb(1 + i, b2) - lb(a1, b1)) for i in range(a2))


BETA_CELLS = [(100, 1000, 120, 1000), (0, 50, 3, 40), (5, 20, 900, 5000), (1, 2, 1, 2), (700, 900, 10, 15)]


def test_beta_posteriors_equal_finite_sums_and_samples(spark):
    rows = bayes.beta_binomial_test(counts(spark, BETA_CELLS)).orderBy("experiment_id").collect()
    rng = np.random.default_rng(0)
    for r, (a, n, c, m) in zip(rows, BETA_CELLS):
        assert r.prob_treatment_better == pytest.approx(exact_beta_win(1 + a, 1 + n - a, 1 + c, 1 + m - c), rel=1e-9)
        mc, mt = (1 + a) / (2 + n), (1 + c) / (2 + m)
        ahead = 1 - exact_beta_win(2 + a, 1 + n - a, 1 + c, 1 + m - c), 1 - exact_beta_win(1 + a, 1 + n - a, 2 + c, 1 + m - c)
        loss = mc * ahead[0] - mt * ahead[1]
        assert r.expected_loss_ship_treatment == pytest.approx(loss, rel=1e-6)
        assert r.expected_loss_ship_control == pytest.approx(loss + mt - mc, rel=1e-6)
        lift = rng.beta(1 + c, 1 + m - c, 400000) / rng.beta(1 + a, 1 + n - a, 400000) - 1
        assert np.mean(lift < r.lift_ci_lower) == pytest.approx(0.025, abs=0.0015)
        assert np.mean(lift < r.lift_ci_upper) == pytest.approx(0.975, abs=0.0015)


def test_normal_posteriors_equal_samples(spark):
    cells = [(100, 10.0, 4.0, 100, 11.0, 4.0), (2, 5.0, 1.0, 3, 6.0, 2.0), (1000, 10.0, 100.0, 500, 9.0, 50.0), (30, 0.5, 9.0, 30, 1.0, 9.0)]
    names = "id int, n_control long, mean_control double, var_control double, n_treatment long, mean_treatment double, var_treatment double"
    rows = bayes.normal_normal_test(spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], names)).orderBy("id").collect()
    rng = np.random.default_rng(1)

    def sample(n, m, v):
        scale = 0.5 + 0.5 * (n - 1) * v
        return m + np.sqrt(1 / rng.gamma(0.5 + n / 2, 1 / scale, 400000) / n) * rng.standard_normal(400000)

    for r, c in zip(rows, cells):
        x, y = sample(*c[:3]), sample(*c[3:])
        lift = (y - x) / abs(x)
        assert r.prob_treatment_better == pytest.approx(np.mean(y > x), abs=0.004)
        assert r.expected_loss_ship_treatment == pytest.approx(np.maximum(x - y, 0).mean(), rel=0.03, abs=1e-4)
        assert r.expected_loss_ship_control - r.expected_loss_ship_treatment == pytest.approx(c[4] - c[1], abs=1e-6)
        assert np.mean(lift < r.lift_ci_lower) == pytest.approx(0.025, abs=0.0015)
        assert np.mean(lift < r.lift_ci_upper) == pytest.approx(0.975, abs=0.0015)


def test_posteriors_do_not_depend_on_partitions(spark):
    df = counts(spark, [(i, 100, i + 3, 100) for i in range(10, 16)])
    a, b = ({r.experiment_id: r.prob_treatment_better for r in bayes.beta_binomial_test(df.repartition(n)).collect()} for n in (1, 7))
    assert a == b


def test_bayes_clear_winner_ships(spark):
    rows = bayes.beta_binomial_test(counts(spark, [(100, 1000, 200, 1000), (200, 1000, 100, 1000)])).orderBy("experiment_id").collect()
    assert [r.decision for r in rows] == ["SHIP", "ABORT"]


def test_normal_posterior_is_close_to_the_sample(spark):
    rng = np.random.default_rng(4)
    c, t = rng.normal(10, 2, 500), rng.normal(11, 2, 500)
    pairs = mom.pair_arms(mom.arm_moments(frame(spark, c, t), K), K)
    r = bayes.normal_normal_test(pairs).first()
    assert r.posterior_mean_control == pytest.approx(c.mean(), abs=1e-6)
    assert r.prob_treatment_better > 0.99 and r.decision == "SHIP"


def test_ratio_power_known_answer(spark):
    df = spark.createDataFrame([(10.0, 2.0, 2.0, 0.0, 0.0, 0.05)], "num_mean double, den_mean double, num_std double, den_std double, correlation double, mde_relative double")
    assert planning.power_ratio(df).first().n_per_group == pytest.approx(251, abs=1)


def test_power_grows_as_the_effect_shrinks(spark):
    base = spark.createDataFrame([(0.1, 50.0, 20.0)], "baseline double, m double, s double")
    grid = planning.scenarios(base, mde_relative=[0.02, 0.05, 0.1])
    for out in (planning.power_proportion(grid), planning.power_mean(grid, "m", "s")):
        ns = [r.sample_size_per_group for r in out.orderBy("mde_relative").collect()]
        assert ns == sorted(ns, reverse=True) and ns[0] > ns[-1]


def test_power_mean_textbook_value(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.5), (1.0, 1.0, 0.2), (1.0, 1.0, 0.8)], "m double, s double, mde_relative double")
    got = {r.mde_relative: r.sample_size_per_group for r in planning.power_mean(df, "m", "s").collect()}
    assert got == {0.5: 64, 0.2: 394, 0.8: 26}


def test_detectable_effect_inverts_power(spark):
    df = spark.createDataFrame([(64, 1.0)], "n_per_group long, baseline_std double")
    assert planning.detectable_effect_mean(df).first().cohens_d == pytest.approx(0.4991, abs=1e-3)


def test_duration_bands(spark):
    df = spark.createDataFrame([(10000, 500.0), (10000, 200.0), (10000, 50.0), (10, 0.0)], "total_sample_size long, daily_traffic double")
    got = [(r.days, r.viable) for r in planning.duration_estimate(df).collect()]
    assert got == [(20, "VIABLE"), (50, "MARGINAL"), (200, "NOT_VIABLE"), (None, None)]


def test_guardrail_rules_differ(spark):
    rng = np.random.default_rng(8)
    df = frame(spark, rng.normal(100, 5, 2000), rng.normal(99.0, 5, 2000))
    pairs = mom.pair_arms(mom.arm_moments(df, K), K)
    assert guardrails.guardrail_test(pairs, "mean", 0.02).first().verdict == "PASS"
    health = guardrails.guardrail_health(df, K, {"value": {"nim": 0.02, "direction": "decrease"}, "gone": {"nim": 0.1}})
    rows = {r.metric: r for r in health.collect()}
    assert rows["value"].verdict == "WARNING" and rows["gone"].error == "metric_missing"


def test_guardrail_needs_a_baseline(spark):
    df = frame(spark, [-1.0, 1.0], [1.0, 2.0])
    r = guardrails.guardrail_test(mom.pair_arms(mom.arm_moments(df, K), K)).first()
    assert r.error == "zero_baseline" and r.verdict is None
