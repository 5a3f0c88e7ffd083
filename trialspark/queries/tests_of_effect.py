"""Moments, two-sample tests, covariate adjustment and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import cuped, hypothesis, moments as mom
from ..operators.corrections import adjust_all
from ..operators.exact import fishers_exact_test, small_sample_switch
from ..operators.segments import segment_effects
from ..plans.experiments import customer_ratio, customer_units
from . import sql as S
from .registry import query

C = F.col
K = ["experiment_id"]
SEG = ["experiment_id", "c_mktsegment"]


def _pairs(spark, sf, value, keys=K):
    return mom.pair_arms(mom.arm_moments(customer_units(spark, sf), keys, value), keys)


def _rounded(df, keep, digits):
    return df.select(*keep, *[rnd(c, d).alias(c) for c, d in digits.items()])


UNIT_PAIRS = f"WITH {S.CUST_UNITS}, {S.moments('m', 'units', 'experiment_id', 'value')}, {S.pairs('p', 'm', 'experiment_id')}"
CONV_PAIRS = f"WITH {S.CUST_UNITS}, {S.moments('m', 'units', 'experiment_id', 'converted')}, {S.pairs('p', 'm', 'experiment_id')}"
SEG_CONV_PAIRS = (
    f"WITH {S.CUST_UNITS}, {S.moments('m', 'units', 'experiment_id, c_mktsegment', 'converted')}, "
    f"{S.pairs('p', 'm', 'experiment_id, c_mktsegment')}"
)


@query("arm_moments", f"""WITH {S.CUST_UNITS}, {S.moments('m', 'units', 'experiment_id', 'value')}
SELECT experiment_id, arm, n, {S.rnd('mean', 3)} AS mean, {S.rnd('sqrt(var)', 3)} AS sd, {S.rnd('total', 2)} AS total FROM m""")
def q_arm_moments(spark, sf):
    m = mom.arm_moments(customer_units(spark, sf), K, "value")
    return m.select("experiment_id", "arm", "n", rnd("mean", 3).alias("mean"),
                    rnd(F.sqrt("var"), 3).alias("sd"), rnd("total", 2).alias("total"))


@query("metric_moments", f"""WITH {S.CUST_UNITS}, long AS (
  SELECT experiment_id, arm, 'revenue' AS metric, value AS v FROM units UNION ALL
  SELECT experiment_id, arm, 'orders', CAST(orders AS DOUBLE) FROM units UNION ALL
  SELECT experiment_id, arm, 'converted', CAST(converted AS DOUBLE) FROM units)
SELECT experiment_id, arm, metric, count(v) AS n, {S.rnd('avg(v)', 3)} AS mean, {S.rnd('stddev_samp(v)', 3)} AS sd
FROM long GROUP BY experiment_id, arm, metric""")
def q_metric_moments(spark, sf):
    m = mom.metric_moments(customer_units(spark, sf), K,
                           {"revenue": "value", "orders": "orders", "converted": "converted"})
    return m.select("experiment_id", "arm", "metric", "n", rnd("mean", 3).alias("mean"),
                    rnd(F.sqrt("var"), 3).alias("sd"))


@query("pair_moments", f"""WITH {S.CUST_RATIO}
SELECT experiment_id, arm, count(*) AS n, {S.rnd('stddev_samp(numerator)', 2)} AS sd_x,
  {S.rnd('var_samp(denominator)', 4)} AS var_y, {S.rnd('covar_samp(numerator, denominator)', 1)} AS cov
FROM ratio_units GROUP BY experiment_id, arm""")
def q_pair_moments(spark, sf):
    m = mom.pair_moments(customer_ratio(spark, sf), K, "numerator", "denominator")
    return m.select("experiment_id", "arm", "n", rnd(F.sqrt("var_x"), 2).alias("sd_x"),
                    rnd("var_y", 4).alias("var_y"), rnd("cov", 1).alias("cov"))


@query("variant_counts", f"""WITH {S.EVENTS}
SELECT experiment_id, arm, count(*) AS n FROM ev GROUP BY experiment_id, arm""")
def q_variant_counts(spark, sf):
    from ..plans.experiments import event_facts
    return mom.variant_counts(event_facts(spark, sf), K)


@query("distinct_arms", f"""WITH {S.EVENTS}
SELECT experiment_id, string_agg(DISTINCT arm, ',' ORDER BY arm) AS arms FROM ev GROUP BY experiment_id""")
def q_distinct_arms(spark, sf):
    from ..plans.experiments import event_facts
    d = mom.distinct_arms(event_facts(spark, sf), K)
    return d.select("experiment_id", F.concat_ws(",", "arms").alias("arms"))


@query("pair_arms", f"""{UNIT_PAIRS}
SELECT experiment_id, arm, n_control, n_treatment, {S.rnd('mean_control', 3)} AS mean_control,
  {S.rnd('mean_treatment', 3)} AS mean_treatment FROM p""")
def q_pair_arms(spark, sf):
    p = _pairs(spark, sf, "value")
    return p.select("experiment_id", "arm", "n_control", "n_treatment",
                    rnd("mean_control", 3).alias("mean_control"), rnd("mean_treatment", 3).alias("mean_treatment"))


WELCH_COLS = {"diff": 3, "se": 3, "df": 4, "t_stat": 6, "p_value": 6, "ci_lower": 2, "ci_upper": 2,
              "cohens_d": 6, "lift_pct": 6}
WELCH_SELECT = ", ".join(f"{S.rnd(c, d)} AS {c}" for c, d in WELCH_COLS.items())


@query("welch_test", f"""{UNIT_PAIRS}, {S.welch('w', 'p')}
SELECT experiment_id, arm, n_control, n_treatment, {WELCH_SELECT}, p_value < 0.05 AS significant,
  {S.magnitude('cohens_d')} AS effect_size FROM w""")
def q_welch(spark, sf):
    w = hypothesis.welch_test(customer_units(spark, sf), K, "value")
    return _rounded(w, ["experiment_id", "arm", "n_control", "n_treatment", "significant", "effect_size"], WELCH_COLS)


PROP_COLS = {"rate_control": 6, "rate_treatment": 6, "diff": 6, "z_stat": 6, "p_value": 6, "ci_lower": 6,
             "ci_upper": 6, "lift_pct": 5}
PROP_SQL = f"""pt0 AS (SELECT *, total_control*1.0/n_control AS rate_control, total_treatment*1.0/n_treatment AS rate_treatment,
  (total_control + total_treatment)*1.0/(n_control + n_treatment) AS pool FROM p),
pt1 AS (SELECT *, rate_treatment - rate_control AS diff,
  sqrt(pool*(1-pool)*(1.0/n_control + 1.0/n_treatment)) AS se0,
  sqrt(rate_control*(1-rate_control)/n_control + rate_treatment*(1-rate_treatment)/n_treatment) AS se FROM pt0),
pt2 AS (SELECT *, CASE WHEN se0 = 0 THEN 0 ELSE diff/se0 END AS z_stat FROM pt1),
pt AS (SELECT *, CASE WHEN se0 = 0 THEN 1 ELSE {S.normal_two_sided('z_stat')} END AS p_value,
  diff - {S.z(.975)!r}*se AS ci_lower, diff + {S.z(.975)!r}*se AS ci_upper,
  CASE WHEN rate_control > 0 THEN diff/rate_control*100 ELSE 'inf'::DOUBLE END AS lift_pct FROM pt2)"""
PROP_SELECT = ", ".join(f"{S.rnd(c, d)} AS {c}" for c, d in PROP_COLS.items())


@query("proportion_test", f"""{CONV_PAIRS}, {PROP_SQL}
SELECT experiment_id, arm, {PROP_SELECT}, p_value < 0.05 AS significant FROM pt""")
def q_proportion(spark, sf):
    t = hypothesis.proportion_test(customer_units(spark, sf), K, "converted")
    return _rounded(t, ["experiment_id", "arm", "significant"], PROP_COLS)


RATIO_M = f"""WITH {S.CUST_RATIO}, rm AS (SELECT experiment_id, arm, count(*) AS n, avg(numerator) AS mean_x,
  avg(denominator) AS mean_y, var_samp(numerator) AS var_x, var_samp(denominator) AS var_y,
  covar_samp(numerator, denominator) AS cov, sum(numerator) AS sum_x, sum(denominator) AS sum_y
  FROM ratio_units GROUP BY experiment_id, arm),
{S.pairs('rp', 'rm', 'experiment_id', 'n mean_x mean_y var_x var_y cov sum_x sum_y')}"""
RATIO_COLS = {"ratio_control": 4, "ratio_treatment": 4, "diff": 4, "se": 5, "z_stat": 6, "p_value": 6,
              "ci_lower": 4, "ci_upper": 4, "lift_pct": 5}


def _dv(s):
    return (f"((var_x_{s} - 2*(sum_x_{s}/sum_y_{s})*cov_{s} + power(sum_x_{s}/sum_y_{s}, 2)*var_y_{s})"
            f"/(mean_y_{s}*mean_y_{s}*n_{s}))")


@query("ratio_metric_test", f"""{RATIO_M}, r0 AS (SELECT *, sum_x_control/sum_y_control AS ratio_control,
  sum_x_treatment/sum_y_treatment AS ratio_treatment, sqrt({_dv('control')} + {_dv('treatment')}) AS se FROM rp),
r1 AS (SELECT *, ratio_treatment - ratio_control AS diff, (ratio_treatment - ratio_control)/se AS z_stat FROM r0),
r AS (SELECT *, {S.normal_two_sided('z_stat')} AS p_value, diff - {S.z(.975)!r}*se AS ci_lower,
  diff + {S.z(.975)!r}*se AS ci_upper, diff/abs(ratio_control)*100 AS lift_pct FROM r1)
SELECT experiment_id, arm, {', '.join(f"{S.rnd(c, d)} AS {c}" for c, d in RATIO_COLS.items())} FROM r""")
def q_ratio(spark, sf):
    t = hypothesis.ratio_metric_test(customer_ratio(spark, sf), K)
    return _rounded(t, ["experiment_id", "arm"], RATIO_COLS)


@query("cohens_d", f"""{UNIT_PAIRS}, d0 AS (SELECT *, (mean_treatment-mean_control)/
  sqrt(((n_control-1)*var_control+(n_treatment-1)*var_treatment)/(n_control+n_treatment-2)) AS d FROM p)
SELECT experiment_id, arm, {S.rnd('d')} AS d, {S.magnitude('d')} AS magnitude FROM d0""")
def q_cohens_d(spark, sf):
    return _rounded(hypothesis.cohens_d(_pairs(spark, sf, "value")), ["experiment_id", "arm", "magnitude"], {"d": 6})


@query("cohens_h", f"""{CONV_PAIRS}, h0 AS (SELECT *, 2*asin(sqrt(total_treatment*1.0/n_treatment)) -
  2*asin(sqrt(total_control*1.0/n_control)) AS h FROM p)
SELECT experiment_id, arm, {S.rnd('h')} AS h, {S.magnitude('h')} AS magnitude,
  CASE WHEN h > 0 THEN 'higher' WHEN h < 0 THEN 'lower' ELSE 'equal' END AS direction FROM h0""")
def q_cohens_h(spark, sf):
    p = _pairs(spark, sf, "converted").withColumns(
        {"rate_control": C("total_control") / C("n_control"), "rate_treatment": C("total_treatment") / C("n_treatment")})
    return _rounded(hypothesis.cohens_h(p), ["experiment_id", "arm", "magnitude", "direction"], {"h": 6})


@query("relative_lift", f"""{UNIT_PAIRS}
SELECT experiment_id, arm, {S.rnd('mean_treatment-mean_control', 3)} AS absolute_diff,
  {S.rnd('(mean_treatment-mean_control)/abs(mean_control)*100')} AS lift_pct FROM p""")
def q_relative_lift(spark, sf):
    return _rounded(hypothesis.relative_lift(_pairs(spark, sf, "value")), ["experiment_id", "arm"],
                    {"absolute_diff": 3, "lift_pct": 6})


@query("computation_trace", f"""{UNIT_PAIRS}
SELECT experiment_id, arm, n_control AS trace_n_control, {S.rnd('sqrt(var_control/n_control + var_treatment/n_treatment)', 3)} AS trace_se,
  'welch: t = diff / se' AS trace_formula FROM p""")
def q_trace(spark, sf):
    w = hypothesis.with_trace(hypothesis.welch_test(customer_units(spark, sf), K), ["n_control", "n_treatment"],
                              ["diff", "se", "df"], "welch: t = diff / se")
    return w.select("experiment_id", "arm", C("computation_trace.inputs.n_control").alias("trace_n_control"),
                    rnd(C("computation_trace.intermediate.se"), 3).alias("trace_se"),
                    C("computation_trace.formula").alias("trace_formula"))


# --- covariate adjustment ------------------------------------------------------

@query("pooled_regression", f"""WITH {S.CUST_UNITS}
SELECT experiment_id, count(*) AS n, {S.rnd('covar_samp(pre_value, value)/var_samp(pre_value)')} AS theta,
  {S.rnd('avg(pre_value)', 3)} AS mean_pre FROM units GROUP BY experiment_id""")
def q_pooled_regression(spark, sf):
    r = cuped.pooled_regression(customer_units(spark, sf), K, "pre_value", "value")
    return r.select("experiment_id", "n", rnd("theta").alias("theta"), rnd("mean_pre", 3).alias("mean_pre"))


@query("correlation", f"""WITH {S.CUST_UNITS}
SELECT experiment_id, {S.rnd('corr(pre_value, value)')} AS correlation FROM units GROUP BY experiment_id""")
def q_correlation(spark, sf):
    r = cuped.correlation(customer_units(spark, sf), K, "pre_value", "value")
    return r.select("experiment_id", rnd("correlation").alias("correlation"))


@query("variance_reduction", f"""WITH {S.CUST_UNITS}, r AS (SELECT experiment_id, corr(pre_value, value) AS c FROM units GROUP BY experiment_id)
SELECT experiment_id, {S.rnd('c')} AS correlation, {S.rnd('c*c*100')} AS variance_reduction_pct,
  CASE WHEN abs(c) < 0.1 THEN 'weak' WHEN abs(c) < 0.3 THEN 'modest' WHEN abs(c) < 0.6 THEN 'moderate' ELSE 'strong' END AS strength FROM r""")
def q_variance_reduction(spark, sf):
    r = cuped.variance_reduction(customer_units(spark, sf), K, "pre_value", "value")
    return r.select("experiment_id", rnd("correlation").alias("correlation"),
                    rnd("variance_reduction_pct").alias("variance_reduction_pct"), "strength")


@query("cuped_adjust", f"""WITH {S.CUST_UNITS}, r AS (SELECT experiment_id, covar_samp(pre_value, value)/var_samp(pre_value) AS theta,
  avg(pre_value) AS mx FROM units GROUP BY experiment_id)
SELECT unit_id, experiment_id, arm, {S.rnd('value - theta*(pre_value - mx)', 2)} AS adjusted FROM units JOIN r USING (experiment_id)""")
def q_cuped_adjust(spark, sf):
    a = cuped.cuped_adjust(customer_units(spark, sf), K, "pre_value", "value")
    return a.select("unit_id", "experiment_id", "arm", rnd("adjusted", 2).alias("adjusted"))


CUPED_COLS = {"theta": 6, "rho": 6, "diff": 2, "raw_diff": 2, "se": 3, "p_value": 6, "ci_lower": 2, "ci_upper": 2,
              "expected_reduction_pct": 5, "realized_reduction_pct": 5}


@query("cuped_welch_test", f"""WITH {S.CUST_UNITS}, th AS (SELECT experiment_id, covar_samp(pre_value, value)/var_samp(pre_value) AS theta,
  corr(pre_value, value) AS rho, avg(pre_value) AS mx FROM units GROUP BY experiment_id),
adj AS (SELECT experiment_id, arm, value, value - theta*(pre_value - mx) AS y, theta, rho FROM units JOIN th USING (experiment_id)),
{S.moments('m', 'adj', 'experiment_id', 'y')}, {S.pairs('p', 'm', 'experiment_id')}, {S.welch('w', 'p')},
raw AS (SELECT experiment_id, avg(value) FILTER (WHERE arm = 'treatment') - avg(value) FILTER (WHERE arm = 'control') AS raw_diff,
  var_samp(value) FILTER (WHERE arm = 'control') AS vc, var_samp(value) FILTER (WHERE arm = 'treatment') AS vt FROM units GROUP BY experiment_id),
j AS (SELECT w.*, th.theta, th.rho, raw.raw_diff, rho*rho*100 AS expected_reduction_pct,
  (1 - ((n_control-1)*var_control + (n_treatment-1)*var_treatment)/((n_control-1)*vc + (n_treatment-1)*vt))*100 AS realized_reduction_pct
  FROM w JOIN th USING (experiment_id) JOIN raw USING (experiment_id))
SELECT experiment_id, arm, {', '.join(f"{S.rnd(c, d)} AS {c}" for c, d in CUPED_COLS.items())} FROM j""")
def q_cuped_welch(spark, sf):
    return _rounded(cuped.cuped_welch_test(customer_units(spark, sf), K), ["experiment_id", "arm"], CUPED_COLS)


# --- exact ---------------------------------------------------------------------

FISHER_CTE = """f0 AS (SELECT *, CAST(total_control AS BIGINT) AS a, CAST(total_treatment AS BIGINT) AS b FROM p),
f1 AS (SELECT *, n_control + n_treatment AS nn, a + b AS good, n_treatment AS drawn,
  greatest(0, n_treatment - (n_control + n_treatment - a - b)) AS lo, least(a + b, n_treatment) AS hi FROM f0),
f2 AS (SELECT *, list_transform(range(lo, hi + 1), lambda k:
   exp(lgamma(good+1)-lgamma(k+1)-lgamma(good-k+1) + lgamma(nn-good+1)-lgamma(drawn-k+1)-lgamma(nn-good-drawn+k+1)
       - lgamma(nn+1)+lgamma(drawn+1)+lgamma(nn-drawn+1))) AS pm FROM f1),
f AS (SELECT *, list_sum(list_filter(pm, lambda x: x <= pm[b - lo + 1]*(1 + 1e-7))) AS p_value,
  ((b+0.5)*(n_control-a+0.5))/((n_treatment-b+0.5)*(a+0.5)) AS odds_ratio,
  sqrt(1/(b+0.5) + 1/(n_treatment-b+0.5) + 1/(a+0.5) + 1/(n_control-a+0.5)) AS se_or FROM f2)"""


@query("fishers_exact_test", f"""{SEG_CONV_PAIRS}, {FISHER_CTE}
SELECT experiment_id, c_mktsegment, arm, {S.rnd('least(1.0, p_value)')} AS p_value, {S.rnd('odds_ratio')} AS odds_ratio,
  {S.rnd(f'exp(ln(odds_ratio) - {S.z(.975)!r}*se_or)')} AS or_ci_lower,
  {S.rnd(f'exp(ln(odds_ratio) + {S.z(.975)!r}*se_or)', 5)} AS or_ci_upper FROM f
WHERE n_control > 0""")
def q_fisher(spark, sf):
    f = fishers_exact_test(_pairs(spark, sf, "converted", SEG).where(C("n_control").isNotNull()))
    return _rounded(f, [*SEG, "arm"], {"p_value": 6, "odds_ratio": 6, "or_ci_lower": 6, "or_ci_upper": 5})


@query("small_sample_switch", f"""{CONV_PAIRS}, {FISHER_CTE}, {PROP_SQL},
j AS (SELECT f.*, pt.p_value AS pz FROM f JOIN pt USING (experiment_id, arm)),
s AS (SELECT *, (n_control < 30 OR total_control < 5 OR n_treatment < 30 OR total_treatment < 5) AS small FROM j)
SELECT experiment_id, arm, CASE WHEN small THEN 'fisher' ELSE 'proportion' END AS test,
  {S.rnd('CASE WHEN small THEN least(1.0, p_value) ELSE pz END')} AS p_value FROM s""")
def q_switch(spark, sf):
    s = small_sample_switch(_pairs(spark, sf, "converted"))
    return s.select("experiment_id", "arm", "test", rnd("p_value").alias("p_value"))


# --- corrections and segments ---------------------------------------------------

def _pvalues(spark, sf):
    """One z test per supplier: families are nations, tests are suppliers' returned share."""
    from ..plans.families import supplier_pvalues
    return supplier_pvalues(spark, sf)


FAM = f"""fam AS (SELECT s_nationkey AS family, l_suppkey AS test_id, count(*) AS n,
  count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
tot AS (SELECT sum(k)*1.0/sum(n) AS p0 FROM fam),
pv AS (SELECT family, test_id, round({S.normal_two_sided('(k*1.0/n - p0)/sqrt(p0*(1-p0)/n)')}, 3) AS p_value FROM fam, tot)"""


@query("adjust_pvalues", f"""WITH {FAM},
o AS (SELECT *, count(*) OVER (PARTITION BY family) AS m,
   row_number() OVER (PARTITION BY family ORDER BY p_value, test_id) AS i FROM pv),
h AS (SELECT *, least(1.0, max((m - i + 1)*p_value) OVER (PARTITION BY family ORDER BY i)) AS holm,
   least(1.0, min(m*p_value/i) OVER (PARTITION BY family ORDER BY i DESC)) AS bh, least(1.0, m*p_value) AS bonf FROM o)
SELECT family, test_id, {S.rnd('p_value', 3)} AS p_value, {S.rnd('holm')} AS p_holm, {S.rnd('bh')} AS p_bh, {S.rnd('bonf')} AS p_bonferroni,
  bh <= 0.05 AS rejected_bh FROM h""")
def q_adjust(spark, sf):
    pv = _pvalues(spark, sf)
    out = adjust_all(pv, ["family"]).withColumnRenamed("p_fdr_bh", "p_bh")
    out = out.withColumn("rejected_bh", C("p_bh") <= 0.05)
    return _rounded(out, ["family", "test_id", "rejected_bh"], {"p_value": 3, "p_holm": 6, "p_bh": 6, "p_bonferroni": 6})


@query("segment_effects", f"""WITH {S.CUST_UNITS}, long AS (
  SELECT region AS experiment_id, arm, value, 'c_mktsegment' AS segment, c_mktsegment AS segment_value FROM units UNION ALL
  SELECT region, arm, value, 'experiment_id', experiment_id FROM units),
{S.moments('m', 'long', 'experiment_id, segment, segment_value', 'value')}, {S.pairs('p', 'm', 'experiment_id, segment, segment_value')},
{S.welch('w', 'p')},
o AS (SELECT *, count(*) OVER (PARTITION BY experiment_id) AS mm,
   row_number() OVER (PARTITION BY experiment_id ORDER BY p_value, segment_value) AS i FROM w),
h AS (SELECT *, least(1.0, max((mm - i + 1)*p_value) OVER (PARTITION BY experiment_id ORDER BY i)) AS holm FROM o)
SELECT experiment_id AS region, segment, segment_value, {S.rnd('diff', 2)} AS diff, {S.rnd('p_value')} AS p_value, {S.rnd('holm', 5)} AS p_adjusted FROM h""")
def q_segment_effects(spark, sf):
    u = customer_units(spark, sf)
    s = segment_effects(u, ["region"], ["c_mktsegment", "experiment_id"], "value")
    return _rounded(s, ["region", "segment", "segment_value"], {"diff": 2, "p_value": 6, "p_adjusted": 5})
