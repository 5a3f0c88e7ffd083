"""Sample ratio, guardrails, sequential, Bayesian and planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import bayes, guardrails as gr, moments as mom, planning, sequential as sq, srm
from ..operators.joins import align_variants
from ..operators.segments import late_ratio
from ..plans.experiments import customer_ratio, customer_units, event_facts, thinned_events
from . import sql as S
from .registry import query
from .tests_of_effect import CONV_PAIRS, K, RATIO_M, UNIT_PAIRS, _pairs, _rounded

C = F.col
TS = "yyyy-MM-dd HH:mm:ss"


def _ts(c):
    return F.date_format(c, TS)


SRM_SQL = f"""c AS (SELECT experiment_id, arm, count(*) AS n FROM thin GROUP BY ALL),
s AS (SELECT experiment_id, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS k, sum(power(n - t/2.0, 2)/(t/2.0)) AS chi2
  FROM (SELECT *, sum(n) OVER (PARTITION BY experiment_id) AS t FROM c) GROUP BY experiment_id),
r AS (SELECT *, {S.chi_one('chi2')} AS p FROM s)"""


@query("srm_check", f"""WITH {S.EVENTS}, {SRM_SQL}
SELECT experiment_id, n_total, {S.rnd('chi2')} AS chi2_stat, {S.rnd('p')} AS p_value, {S.srm_label('p', 0.01)} AS verdict FROM r""")
def q_srm_check(spark, sf):
    r = srm.srm_check(thinned_events(spark, sf), K)
    return r.select("experiment_id", "n_total", rnd("chi2_stat").alias("chi2_stat"), rnd("p_value").alias("p_value"), "verdict")


@query("srm_check_ratios", f"""WITH {S.EVENTS}, c AS (SELECT event_type AS arm, count(*) AS n FROM ev GROUP BY event_type),
x AS (SELECT arm, n, CASE arm WHEN 'view' THEN 0.25 WHEN 'click' THEN 0.25 WHEN 'purchase' THEN 0.25 WHEN 'error' THEN 0.125 ELSE 0.125 END AS r,
  sum(n) OVER () AS t FROM c),
s AS (SELECT CAST(sum(n) AS BIGINT) AS n_total, count(*) AS k, sum(power(n - t*r, 2)/(t*r)) AS chi2 FROM x)
SELECT 'all' AS experiment_id, n_total, {S.rnd('chi2', 4)} AS chi2_stat, {S.rnd('exp(-chi2/2)*(1 + chi2/2)')} AS p_value,
  {S.srm_label('exp(-chi2/2)*(1 + chi2/2)', 0.01)} AS verdict FROM s""")
def q_srm_ratios(spark, sf):
    ev = event_facts(spark, sf).withColumn("experiment_id", F.lit("all"))
    shares = {"view": 2, "click": 2, "purchase": 2, "error": 1, "signup": 1}
    r = srm.srm_check(ev, K, "event_type", shares)
    return r.select("experiment_id", "n_total", rnd("chi2_stat", 4).alias("chi2_stat"), rnd("p_value").alias("p_value"), "verdict")


@query("srm_diagnose", f"""WITH {S.CUST_UNITS}, long AS (
  SELECT region, arm, 'overall' AS segment, 'all' AS segment_value FROM units UNION ALL
  SELECT region, arm, 'c_mktsegment', c_mktsegment FROM units UNION ALL
  SELECT region, arm, 'experiment_id', experiment_id FROM units),
c AS (SELECT region, segment, segment_value, arm, count(*) AS n FROM long GROUP BY ALL),
s AS (SELECT region, segment, segment_value, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS k, sum(power(n - t*1.0/kk, 2)/(t*1.0/kk)) AS chi2
  FROM (SELECT *, sum(n) OVER w AS t, count(*) OVER w AS kk FROM c WINDOW w AS (PARTITION BY region, segment, segment_value)) GROUP BY ALL),
r AS (SELECT *, CASE WHEN k = 2 THEN {S.chi_one('chi2')} END AS p FROM s)
SELECT region, segment, segment_value, n_total, {S.rnd('p')} AS p_value, {S.srm_label('p', 0.01)} AS verdict,
  CASE WHEN k < 2 THEN 'single_arm' END AS reason FROM r""")
def q_srm_diagnose(spark, sf):
    u = customer_units(spark, sf)
    r = srm.srm_diagnose(u, ["region"], "arm", ["c_mktsegment", "experiment_id"])
    return r.select("region", "segment", "segment_value", "n_total", rnd("p_value").alias("p_value"), "verdict", "reason")


def _trend_sql(bucket: str) -> str:
    return f"""d0 AS (SELECT experiment_id, min(date_trunc('day', event_at)) AS day0 FROM thin GROUP BY experiment_id),
wc AS (SELECT experiment_id, {bucket} AS ws, arm, count(*) AS n FROM thin JOIN d0 USING (experiment_id) GROUP BY ALL),
ks AS (SELECT experiment_id, count(DISTINCT arm) AS k FROM thin GROUP BY experiment_id),
grid AS (SELECT DISTINCT w.experiment_id, w.ws, a.arm FROM wc w JOIN (SELECT DISTINCT experiment_id, arm FROM thin) a USING (experiment_id)),
al AS (SELECT g.experiment_id, g.ws, g.arm, coalesce(n, 0) AS n FROM grid g LEFT JOIN wc USING (experiment_id, ws, arm)),
wt AS (SELECT *, sum(n) OVER (PARTITION BY experiment_id, ws) AS t FROM al),
wx AS (SELECT experiment_id, ws, CAST(sum(n) AS BIGINT) AS n_total, sum(power(n - t/2.0, 2)/(t/2.0)) AS chi2 FROM wt GROUP BY ALL),
w AS (SELECT *, {S.chi_one('chi2')} AS p FROM wx), wv AS (SELECT *, {S.srm_label('p', 0.0005)} AS verdict FROM w)"""


DAY = "date_trunc('day', event_at)"
WEEK = "day0 + INTERVAL 1 DAY * (7 * (date_diff('day', day0, date_trunc('day', event_at)) // 7))"
SUMMARY = """o AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY ws) AS i, count(*) OVER (PARTITION BY experiment_id) AS nw FROM wv),
g AS (SELECT experiment_id, count(*) AS n_windows, min(ws) FILTER (WHERE verdict <> 'PASS') AS first_violation,
  max(i) - coalesce(max(i) FILTER (WHERE verdict = 'PASS'), 0) AS consecutive_violations,
  avg(p) FILTER (WHERE i > nw - greatest(1, nw // 2)) - avg(p) FILTER (WHERE i <= greatest(1, nw // 2)) AS delta,
  bool_or(verdict = 'BLOCK') AS b, bool_or(verdict = 'WARNING') AS wn FROM o GROUP BY experiment_id)
SELECT experiment_id, n_windows, strftime(first_violation, '%Y-%m-%d %H:%M:%S') AS first_violation, consecutive_violations,
  CASE WHEN n_windows < 2 THEN 'stable' WHEN delta > 0.05 THEN 'improving' WHEN delta < -0.05 THEN 'worsening' ELSE 'stable' END AS trend_direction,
  CASE WHEN b THEN 'BLOCK' WHEN wn THEN 'WARNING' ELSE 'PASS' END AS verdict FROM g"""


@query("srm_windows", f"""WITH {S.EVENTS}, {_trend_sql(DAY)}
SELECT experiment_id, strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, n_total, {S.rnd('p')} AS p_value, verdict FROM wv""")
def q_srm_windows(spark, sf):
    w = srm.srm_windows(thinned_events(spark, sf), K, "event_at", "1d")
    return w.select("experiment_id", _ts("window_start").alias("window_start"), "n_total", rnd("p_value").alias("p_value"), "verdict")


def _trend(df):
    return df.select("experiment_id", "n_windows", _ts("first_violation").alias("first_violation"),
                     "consecutive_violations", "trend_direction", "verdict")


@query("srm_trend", f"WITH {S.EVENTS}, {_trend_sql(DAY)}, {SUMMARY}")
def q_srm_trend(spark, sf):
    return _trend(srm.srm_trend(thinned_events(spark, sf), K, "event_at", "1d"))


@query("srm_trend_weekly", f"WITH {S.EVENTS}, {_trend_sql(WEEK)}, {SUMMARY}")
def q_srm_trend_weekly(spark, sf):
    return _trend(srm.srm_trend(thinned_events(spark, sf), K, "event_at", "1w"))


@query("align_variants", f"""WITH {S.EVENTS}, c AS (SELECT experiment_id, date_trunc('hour', event_at) AS h, arm, count(*) AS n FROM thin GROUP BY ALL),
g AS (SELECT DISTINCT c.experiment_id, c.h, a.arm FROM c JOIN (SELECT DISTINCT experiment_id, arm FROM c) a USING (experiment_id))
SELECT experiment_id, strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, arm, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (experiment_id, h, arm)""")
def q_align(spark, sf):
    counts = srm.windowed_counts(thinned_events(spark, sf), K, "event_at", "1h")
    a = align_variants(counts, K, "window_start")
    return a.select("experiment_id", _ts("window_start").alias("window_start"), "arm", "n")


@query("denominator_srm", f"""{RATIO_M}, d AS (SELECT *, power(sum_y_control - (sum_y_control+sum_y_treatment)/2, 2)/((sum_y_control+sum_y_treatment)/2)*2 AS chi2 FROM rp),
e AS (SELECT *, {S.chi_one('chi2')} AS p FROM d)
SELECT experiment_id, arm, {S.rnd('chi2')} AS chi2_stat, {S.rnd('p')} AS p_value, {S.rnd('sum_y_control/sum_y_treatment')} AS observed_ratio,
  CASE WHEN p >= 0.1 THEN 'PASS' WHEN p >= 0.05 THEN 'WARNING' ELSE 'BLOCK' END AS verdict FROM e""")
def q_denominator(spark, sf):
    p = mom.pair_arms(mom.pair_moments(customer_ratio(spark, sf), K, "numerator", "denominator"), K)
    return _rounded(srm.denominator_srm(p), ["experiment_id", "arm", "verdict"], {"chi2_stat": 6, "p_value": 6, "observed_ratio": 6})


@query("expected_shape_check", f"""WITH {S.EVENTS}, c AS (SELECT experiment_id, arm, count(*) AS n FROM thin GROUP BY ALL),
x AS (SELECT * FROM (SELECT DISTINCT experiment_id FROM c), (VALUES ('control', 0.5), ('holdout', 0.1), ('treatment', 0.4)) v(arm, share)),
j AS (SELECT coalesce(x.experiment_id, c.experiment_id) AS experiment_id, coalesce(x.arm, c.arm) AS arm, coalesce(n, 0) AS n, share FROM x FULL JOIN c ON x.experiment_id = c.experiment_id AND x.arm = c.arm),
o AS (SELECT *, n*1.0/sum(n) OVER (PARTITION BY experiment_id) AS obs FROM j)
SELECT experiment_id, arm, n, {S.rnd('share')} AS expected_share, {S.rnd('obs')} AS observed_share,
  CASE WHEN share IS NULL THEN 'unexpected_arm' WHEN n = 0 THEN 'missing_arm' WHEN abs(obs - share) > 0.01 THEN 'ratio_drift' ELSE 'match' END AS status FROM o""")
def q_shape(spark, sf):
    r = srm.expected_shape_check(thinned_events(spark, sf), K, {"control": 0.5, "treatment": 0.4, "holdout": 0.1})
    return _rounded(r, ["experiment_id", "arm", "n", "status"], {"expected_share": 6, "observed_share": 6})


# --- guardrails ------------------------------------------------------------------

GUARD_COLS = {"point_estimate": 3, "oriented_effect": 3, "ni_margin": 3, "worst_case_effect": 2, "p_value": 6}


@query("guardrail_test", f"""{UNIT_PAIRS}, a AS (SELECT *, mean_treatment - mean_control AS point_estimate,
  sqrt(var_control/n_control + var_treatment/n_treatment) AS se,
  power(var_control/n_control + var_treatment/n_treatment, 2) / (power(var_control/n_control, 2)/(n_control-1) + power(var_treatment/n_treatment, 2)/(n_treatment-1)) AS df FROM p),
{S.t_crit_ctes('a', 'b', 0.95)},
g0 AS (SELECT *, -point_estimate AS oriented_effect, -abs(0.02*mean_control) AS ni_margin, -point_estimate - crit*se AS worst_case_effect FROM b),
g1 AS (SELECT *, (oriented_effect - ni_margin)/se AS zz FROM g0),
g AS (SELECT *, CASE WHEN zz >= 0 THEN {S.t_tail('abs(zz)', 'df')} ELSE 1 - {S.t_tail('abs(zz)', 'df')} END AS p_value FROM g1)
SELECT experiment_id, arm, {', '.join(f"{S.rnd(c, d)} AS {c}" for c, d in GUARD_COLS.items())},
  CASE WHEN oriented_effect < ni_margin THEN 'BLOCK' WHEN worst_case_effect < ni_margin THEN 'WARNING' ELSE 'PASS' END AS verdict FROM g""")
def q_guardrail(spark, sf):
    g = gr.guardrail_test(_pairs(spark, sf, "value"), "mean", 0.02, 0.05, invert=True)
    return _rounded(g, ["experiment_id", "arm", "verdict"], GUARD_COLS)


@query("guardrail_test_proportion", f"""{CONV_PAIRS}, a AS (SELECT *, total_control*1.0/n_control AS rc, total_treatment*1.0/n_treatment AS rt FROM p),
b AS (SELECT *, rt - rc AS point_estimate, rt - rc AS oriented_effect, -abs(0.05*rc) AS ni_margin,
  sqrt(rc*(1-rc)/n_control + rt*(1-rt)/n_treatment) AS se FROM a),
g0 AS (SELECT *, oriented_effect - {S.z(.95)!r}*se AS worst_case_effect, (oriented_effect - ni_margin)/se AS zz FROM b),
g AS (SELECT *, 1 - {S.normal_cdf('zz')} AS p_value FROM g0)
SELECT experiment_id, arm, {', '.join(f"{S.rnd(c, 6)} AS {c}" for c in GUARD_COLS)},
  CASE WHEN oriented_effect < ni_margin THEN 'BLOCK' WHEN worst_case_effect < ni_margin THEN 'WARNING' ELSE 'PASS' END AS verdict FROM g""")
def q_guardrail_p(spark, sf):
    g = gr.guardrail_test(_pairs(spark, sf, "converted"), "proportion", 0.05)
    return _rounded(g, ["experiment_id", "arm", "verdict"], dict.fromkeys(GUARD_COLS, 6))


RAILS = {
    "value": {"nim": 0.02, "direction": "decrease", "type": "continuous"},
    "converted": {"nim": 0.05, "direction": "decrease", "type": "binary"},
    "orders": {"nim": 0.5, "direction": "increase", "type": "continuous"},
}
RAIL_SQL = f"""WITH {S.CUST_UNITS}, {S.moments('mv', 'units', 'experiment_id', 'value')}, {S.moments('mo', 'units', 'experiment_id', 'orders')}, {S.moments('mc', 'units', 'experiment_id', 'converted')},
{S.pairs('pv0', 'mv', 'experiment_id')}, {S.pairs('po0', 'mo', 'experiment_id')}, {S.pairs('p', 'mc', 'experiment_id')},
lng AS (SELECT 'value' AS metric, 0.02 AS nim, TRUE AS down, * FROM pv0 UNION ALL SELECT 'orders', 0.5, FALSE, * FROM po0),
{S.welch('wl', 'lng')},
pr0 AS (SELECT *, total_control*1.0/n_control AS rc, total_treatment*1.0/n_treatment AS rt, (total_control+total_treatment)*1.0/(n_control+n_treatment) AS pool FROM p),
pr1 AS (SELECT *, rt-rc AS diff, sqrt(rc*(1-rc)/n_control + rt*(1-rt)/n_treatment) AS se, (rt-rc)/sqrt(pool*(1-pool)*(1.0/n_control+1.0/n_treatment)) AS zz FROM pr0),
un AS (SELECT experiment_id, arm, metric, nim, down, mean_control AS baseline, diff, ci_lower, ci_upper, p_value FROM wl UNION ALL
  SELECT experiment_id, arm, 'converted', 0.05, TRUE, rc, diff, diff - {S.z(.975)!r}*se, diff + {S.z(.975)!r}*se, {S.normal_two_sided('zz')} FROM pr1),
h0 AS (SELECT *, CASE WHEN down THEN -nim*abs(baseline) ELSE nim*abs(baseline) END AS margin, CASE WHEN down THEN ci_lower ELSE ci_upper END AS worst FROM un),
h AS (SELECT *, CASE WHEN (down AND worst < margin) OR (NOT down AND worst > margin) THEN 'BLOCK'
   WHEN ((down AND diff < 0) OR (NOT down AND diff > 0)) AND p_value < 0.05 THEN 'WARNING' ELSE 'PASS' END AS verdict FROM h0)"""


@query("guardrail_health", f"""{RAIL_SQL}
SELECT experiment_id, arm, metric, {S.rnd('diff', 3)} AS diff, {S.rnd('margin', 3)} AS margin, {S.rnd('worst', 2)} AS worst_case_effect, {S.rnd('p_value')} AS p_value, verdict FROM h""")
def q_rail_health(spark, sf):
    h = gr.guardrail_health(customer_units(spark, sf), K, RAILS)
    return _rounded(h, ["experiment_id", "arm", "metric", "verdict"], {"diff": 3, "margin": 3, "worst_case_effect": 2, "p_value": 6})


@query("worst_verdict", f"""{RAIL_SQL}
SELECT experiment_id, CASE WHEN bool_or(verdict = 'BLOCK') THEN 'BLOCK' WHEN bool_or(verdict = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS verdict,
  coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE verdict <> 'PASS'), '') AS flagged FROM h GROUP BY experiment_id""")
def q_worst(spark, sf):
    w = gr.worst_verdict(gr.guardrail_health(customer_units(spark, sf), K, RAILS), K)
    return w.select("experiment_id", "verdict", F.concat_ws(",", "flagged_metrics").alias("flagged"))


# --- sequential -------------------------------------------------------------------

def _mix(sigma2: str, src: str, out: str) -> str:
    return f"""{out}_a AS (SELECT *, {sigma2} AS s2, n_control*1.0*n_treatment/(n_control+n_treatment) AS ne FROM {src}),
{out}_b AS (SELECT *, s2 + ne*s2 AS den, ln(sqrt((s2 + ne*s2)/s2)/0.05) AS lt FROM {out}_a),
{out} AS (SELECT *, sqrt(2*s2*den/(ne*ne*s2)*lt) AS radius, sqrt(s2/den)*exp(ne*ne*diff*diff*s2/(2*s2*den)) AS e_value FROM {out}_b)"""


POOLED = "((n_control-1)*var_control + (n_treatment-1)*var_treatment)/(n_control+n_treatment-2)"
MEAN_DIFF = "d AS (SELECT *, mean_treatment - mean_control AS diff FROM p)"


@query("msprt_test", f"""{UNIT_PAIRS}, {MEAN_DIFF}, {_mix(POOLED, 'd', 's')}
SELECT experiment_id, arm, {S.rnd('diff', 3)} AS diff, {S.rnd('radius', 3)} AS radius, {S.rnd('e_value', 8)} AS e_value,
  CASE WHEN (diff - radius > 0 OR diff + radius < 0) AND n_control >= 30 AND n_treatment >= 30 THEN 'STOP_REJECT' ELSE 'CONTINUE' END AS decision FROM s""")
def q_msprt(spark, sf):
    return _rounded(sq.msprt_test(_pairs(spark, sf, "value")), ["experiment_id", "arm", "decision"], {"diff": 3, "radius": 3, "e_value": 8})


@query("always_valid_ci", f"""{UNIT_PAIRS}, {MEAN_DIFF}, {_mix(POOLED, 'd', 's')}
SELECT experiment_id, arm, {S.rnd('diff - radius', 2)} AS av_ci_lower, {S.rnd('diff + radius', 2)} AS av_ci_upper FROM s""")
def q_avci(spark, sf):
    return _rounded(sq.always_valid_ci(_pairs(spark, sf, "value")), ["experiment_id", "arm"], {"av_ci_lower": 2, "av_ci_upper": 2})


@query("sequential_proportion_test", f"""{CONV_PAIRS}, d AS (SELECT *, total_control*1.0/n_control AS rc, total_treatment*1.0/n_treatment AS rt, total_treatment*1.0/n_treatment - total_control*1.0/n_control AS diff FROM p),
{_mix('greatest((rc*(1-rc) + rt*(1-rt))/2, 1e-6)', 'd', 's')}
SELECT experiment_id, arm, {S.rnd('diff')} AS diff, {S.rnd('radius')} AS radius, {S.rnd('e_value')} AS e_value,
  CASE WHEN diff - radius > 0 OR diff + radius < 0 THEN 'STOP_REJECT' ELSE 'CONTINUE' END AS decision FROM s""")
def q_seq_prop(spark, sf):
    return _rounded(sq.sequential_proportion_test(_pairs(spark, sf, "converted")), ["experiment_id", "arm", "decision"],
                    {"diff": 6, "radius": 6, "e_value": 6})


def _daily(spark, sf):
    return event_facts(spark, sf).withColumn("look", F.to_date("event_at"))


CUM = f"""WITH {S.EVENTS}, days AS (SELECT DISTINCT experiment_id, CAST(event_at AS DATE) AS look FROM ev),
m AS (SELECT d.experiment_id, d.look, e.arm, count(e.value) AS n, avg(e.value) AS mean, var_samp(e.value) AS var, sum(e.value) AS total
  FROM days d JOIN ev e ON e.experiment_id = d.experiment_id AND CAST(e.event_at AS DATE) <= d.look GROUP BY ALL)"""


@query("cumulative_sufficient_stats", f"""{CUM}, present AS (SELECT DISTINCT experiment_id, CAST(event_at AS DATE) AS look, arm FROM ev)
SELECT experiment_id, strftime(look, '%Y-%m-%d') AS look, arm, n, {S.rnd('mean')} AS mean, {S.rnd('var', 4)} AS var, {S.rnd('total', 3)} AS total
FROM m JOIN present USING (experiment_id, look, arm)""")
def q_cumulative(spark, sf):
    s = sq.cumulative_sufficient_stats(_daily(spark, sf), K, "look")
    return s.select("experiment_id", F.date_format("look", "yyyy-MM-dd").alias("look"), "arm", C("n").cast("long").alias("n"),
                    rnd("mean").alias("mean"), rnd("var", 4).alias("var"), rnd("total", 3).alias("total"))


PATH = f"""{CUM}, p AS (SELECT t.experiment_id, t.look, t.arm, c.n AS n_control, t.n AS n_treatment, c.mean AS mean_control, t.mean AS mean_treatment,
  c.var AS var_control, t.var AS var_treatment FROM m t JOIN m c ON t.experiment_id = c.experiment_id AND t.look = c.look AND c.arm = 'control' WHERE t.arm = 'treatment'),
{MEAN_DIFF}, {_mix(f'greatest({POOLED}, 1e-12)', 'd', 's')},
x AS (SELECT *, CASE WHEN (diff - radius > 0 OR diff + radius < 0) AND n_control >= 30 AND n_treatment >= 30 THEN 'STOP_REJECT' ELSE 'CONTINUE' END AS decision,
  row_number() OVER (PARTITION BY experiment_id, arm ORDER BY look) AS look_no FROM s)"""


@query("sequential_path", f"""{PATH}
SELECT experiment_id, strftime(look, '%Y-%m-%d') AS look, CAST(look_no AS INTEGER) AS look_no, n_control, n_treatment, {S.rnd('diff', 5)} AS diff, {S.rnd('radius', 4)} AS radius, decision,
  strftime(min(look) FILTER (WHERE decision = 'STOP_REJECT') OVER (PARTITION BY experiment_id, arm), '%Y-%m-%d') AS first_stop FROM x""")
def q_path(spark, sf):
    p = sq.sequential_path(_daily(spark, sf), K, "look")
    return p.select("experiment_id", F.date_format("look", "yyyy-MM-dd").alias("look"), "look_no",
                    C("n_control").cast("long").alias("n_control"), C("n_treatment").cast("long").alias("n_treatment"),
                    rnd("diff", 5).alias("diff"), rnd("radius", 4).alias("radius"), "decision",
                    F.date_format("first_stop", "yyyy-MM-dd").alias("first_stop"))


def _boundaries(kind: str) -> str:
    if kind == "obrien_fleming":
        spend = lambda t: f"(2*{S.normal_tail(f'({S.z(.975)!r}/sqrt({t}))')})"
    else:
        spend = lambda t: f"(0.05*ln(1 + (exp(1.0)-1)*({t})))"
    # The boundary is checked through its tail probability, which needs no quantile.
    return f"""l AS (SELECT experiment_id, CAST(event_at AS DATE) AS look, row_number() OVER (PARTITION BY experiment_id ORDER BY CAST(event_at AS DATE)) AS k
  FROM ev GROUP BY experiment_id, CAST(event_at AS DATE)), n AS (SELECT *, count(*) OVER (PARTITION BY experiment_id) AS kk FROM l),
b AS (SELECT *, {spend('(k*1.0/kk)')} AS cum, CASE WHEN k > 1 THEN {spend('((k-1)*1.0/kk)')} ELSE 0 END AS prev FROM n)
SELECT experiment_id, CAST(k AS INTEGER) AS look_no, {S.rnd('cum', 7)} AS cumulative_alpha, {S.rnd('greatest(cum - prev, 1e-12)', 7)} AS incremental_alpha,
  {S.rnd('greatest(cum - prev, 1e-12)', 7)} AS boundary_tail FROM b"""


def _looks(spark, sf):
    days = event_facts(spark, sf).select("experiment_id", F.to_date("event_at").alias("look")).distinct()
    from pyspark.sql import Window
    w = Window.partitionBy("experiment_id")
    return days.withColumns({"look_no": F.row_number().over(w.orderBy("look")), "n_looks": F.count(F.lit(1)).over(w)})


def _bound(spark, sf, spending):
    from ..functions.distributions import norm_two_sided
    g = sq.group_sequential_boundaries(_looks(spark, sf), "look_no", "n_looks", 0.05, spending)
    return g.select("experiment_id", "look_no", rnd("cumulative_alpha", 7).alias("cumulative_alpha"),
                    rnd("incremental_alpha", 7).alias("incremental_alpha"),
                    rnd(norm_two_sided(C("z_boundary")), 7).alias("boundary_tail"))


@query("group_sequential_obrien_fleming", f"WITH {S.EVENTS}, {_boundaries('obrien_fleming')}")
def q_obf(spark, sf):
    return _bound(spark, sf, "obrien_fleming")


@query("group_sequential_pocock", f"WITH {S.EVENTS}, {_boundaries('pocock')}")
def q_pocock(spark, sf):
    return _bound(spark, sf, "pocock")


@query("late_ratio", f"""WITH {S.EVENTS}, e AS (SELECT experiment_id, epoch_us(min(event_at)) AS t0, epoch_us(max(event_at)) AS t1 FROM ev GROUP BY experiment_id),
x AS (SELECT ev.*, (epoch_us(event_at) - t0)*1.0/(t1 - t0) AS pos FROM ev JOIN e USING (experiment_id)),
g AS (SELECT experiment_id,
 avg(value) FILTER (WHERE arm = 'treatment' AND pos < 1.0/3) - avg(value) FILTER (WHERE arm = 'control' AND pos < 1.0/3) AS early,
 avg(value) FILTER (WHERE arm = 'treatment' AND pos >= 2.0/3) - avg(value) FILTER (WHERE arm = 'control' AND pos >= 2.0/3) AS late FROM x GROUP BY experiment_id)
SELECT experiment_id, {S.rnd('early')} AS early_effect, {S.rnd('late')} AS late_effect, {S.rnd('late/early', 5)} AS late_ratio FROM g""")
def q_late(spark, sf):
    r = late_ratio(event_facts(spark, sf), K, "event_at")
    return _rounded(r, ["experiment_id"], {"early_effect": 6, "late_effect": 6, "late_ratio": 5})


# --- Bayes --------------------------------------------------------------------------

BETA = ["post_alpha_control", "post_beta_control", "post_alpha_treatment", "post_beta_treatment"]


@query("beta_binomial_posterior", f"""{CONV_PAIRS}, b AS (SELECT *, total_control + 1.0 AS ac, n_control - total_control + 1.0 AS bc, total_treatment + 1.0 AS a_t, n_treatment - total_treatment + 1.0 AS bt FROM p)
SELECT experiment_id, arm, {S.rnd('ac/(ac+bc)')} AS posterior_mean_control, {S.rnd('a_t/(a_t+bt)')} AS posterior_mean_treatment,
  {S.rnd('(a_t/(a_t+bt) - ac/(ac+bc))/(ac/(ac+bc))')} AS relative_lift FROM b""")
def q_beta_post(spark, sf):
    b = bayes.beta_binomial_posterior(_pairs(spark, sf, "converted"))
    return _rounded(b, ["experiment_id", "arm"], {"posterior_mean_control": 6, "posterior_mean_treatment": 6, "relative_lift": 6})


def _np(s):
    return (f"(1e-12*0.0 + n_{s}*mean_{s})/(1e-12 + n_{s}) AS mu_{s}, 0.5 + n_{s}/2.0 AS shape_{s}, "
            f"0.5 + 0.5*(n_{s}-1)*var_{s} + 0.5*(1e-12*n_{s}/(1e-12+n_{s}))*mean_{s}*mean_{s} AS scale_{s}")


@query("normal_posterior", f"""{UNIT_PAIRS}, b AS (SELECT *, {_np('control')}, {_np('treatment')} FROM p)
SELECT experiment_id, arm, {S.rnd('mu_control', 3)} AS mu_control, {S.rnd('shape_control', 3)} AS shape_control, {S.rnd('sqrt(scale_control)', 2)} AS root_scale_control,
  {S.rnd('mu_treatment', 3)} AS mu_treatment, {S.rnd('sqrt(scale_treatment)', 2)} AS root_scale_treatment FROM b""")
def q_norm_post(spark, sf):
    b = bayes.normal_posterior(_pairs(spark, sf, "value"))
    return b.select("experiment_id", "arm", rnd("post_mu_control", 3).alias("mu_control"), rnd("post_shape_control", 3).alias("shape_control"),
                    rnd(F.sqrt("post_scale_control"), 2).alias("root_scale_control"), rnd("post_mu_treatment", 3).alias("mu_treatment"),
                    rnd(F.sqrt("post_scale_treatment"), 2).alias("root_scale_treatment"))


BAYES_OUT = {"prob_treatment_better": 6, "relative_lift": 6, "lift_ci_lower": 6, "lift_ci_upper": 6,
             "expected_loss_ship_treatment_rel": 6, "expected_loss_ship_control_rel": 6}


@query("beta_binomial_test")
def q_beta(spark, sf):
    return _rounded(bayes.beta_binomial_test(_pairs(spark, sf, "converted")), ["experiment_id", "arm", "decision"], BAYES_OUT)


def _wins(a1, b1, a2, b2):
    """P(Beta(a2, b2) > Beta(a1, b1)) as a finite sum; a2 is a whole number."""
    lb = lambda a, b: f"(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
    return (f"list_sum(list_transform(range(0, CAST({a2} AS BIGINT)), lambda i: exp({lb(f'({a1} + i)', f'({b1} + {b2})')} - ln({b2} + i) "
            f"- {lb('(1.0 + i)', b2)} - {lb(a1, b1)})))")


@query("beta_binomial_wins", f"""{CONV_PAIRS}, b AS (SELECT *, total_control + 1.0 AS ac, n_control - total_control + 1.0 AS bc, total_treatment + 1.0 AS a_t, n_treatment - total_treatment + 1.0 AS bt FROM p),
w AS (SELECT experiment_id, arm, ac/(ac+bc) AS mc, a_t/(a_t+bt) AS mt, {_wins('ac', 'bc', 'a_t', 'bt')} AS pw, {_wins('(ac + 1)', 'bc', 'a_t', 'bt')} AS pw_c, {_wins('ac', 'bc', '(a_t + 1)', 'bt')} AS pw_t FROM b),
l AS (SELECT *, mc*(1 - pw_c) - mt*(1 - pw_t) AS lt FROM w), r AS (SELECT *, (lt + mt - mc)/mc AS rc, lt/mc AS rt FROM l)
SELECT experiment_id, arm, {S.rnd('pw')} AS prob_treatment_better, {S.rnd('rt')} AS expected_loss_ship_treatment_rel, {S.rnd('rc')} AS expected_loss_ship_control_rel,
  CASE WHEN rt < 0.005 AND pw >= 0.5 THEN 'SHIP' WHEN rc < 0.005 AND pw < 0.5 THEN 'ABORT' ELSE 'CONTINUE' END AS decision FROM r""")
def q_beta_wins(spark, sf):
    """The part of the Beta test that finite sums can say."""
    return _rounded(bayes.beta_binomial_test(_pairs(spark, sf, "converted")), ["experiment_id", "arm", "decision"],
                    {c: 6 for c in ("prob_treatment_better", "expected_loss_ship_treatment_rel", "expected_loss_ship_control_rel")})


@query("normal_normal_test")
def q_normal(spark, sf):
    return _rounded(bayes.normal_normal_test(_pairs(spark, sf, "value")), ["experiment_id", "arm", "decision"], BAYES_OUT)


def _draws(spark, sf):
    """Line items as paired draws: price after discount against price after tax."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.select(C("l_returnflag").alias("cell"), (C("l_extendedprice") * (1 - C("l_discount"))).alias("c"),
                     (C("l_extendedprice") * (1 - C("l_tax"))).alias("t"))


DRAWS = "draws AS (SELECT l_returnflag AS cell, l_extendedprice*(1-l_discount) AS c, l_extendedprice*(1-l_tax) AS t FROM lineitem)"


@query("probability_to_beat", f"WITH {DRAWS} SELECT cell, {S.rnd('avg(CASE WHEN t > c THEN 1.0 ELSE 0.0 END)')} AS prob_treatment_better FROM draws GROUP BY cell")
def q_ptb(spark, sf):
    return _rounded(bayes.probability_to_beat(_draws(spark, sf), ["cell"]), ["cell"], {"prob_treatment_better": 6})


@query("expected_loss", f"""WITH {DRAWS}, g AS (SELECT cell, avg(greatest(c - t, 0)) AS lt, avg(greatest(t - c, 0)) AS lc, avg(c) AS m FROM draws GROUP BY cell)
SELECT cell, {S.rnd('lt', 4)} AS loss_ship_treatment, {S.rnd('lc', 4)} AS loss_ship_control, {S.rnd('lt/abs(m)')} AS loss_ship_treatment_rel, {S.rnd('lc/abs(m)')} AS loss_ship_control_rel FROM g""")
def q_loss(spark, sf):
    return _rounded(bayes.expected_loss(_draws(spark, sf), ["cell"]), ["cell"],
                    {"loss_ship_treatment": 4, "loss_ship_control": 4, "loss_ship_treatment_rel": 6, "loss_ship_control_rel": 6})


@query("credible_interval", f"""WITH {DRAWS} SELECT cell, {S.rnd('quantile_cont((t-c)/abs(c), 0.025)', 7)} AS lift_ci_lower, {S.rnd('quantile_cont((t-c)/abs(c), 0.975)', 7)} AS lift_ci_upper FROM draws WHERE abs(c) >= 1e-12 GROUP BY cell""")
def q_cri(spark, sf):
    return _rounded(bayes.credible_interval(_draws(spark, sf), ["cell"]), ["cell"], {"lift_ci_lower": 7, "lift_ci_upper": 7})


@query("bayes_decision", f"""WITH {DRAWS}, g AS (SELECT cell, avg(greatest(c - t, 0))/abs(avg(c)) AS lt, avg(greatest(t - c, 0))/abs(avg(c)) AS lc, avg(CASE WHEN t > c THEN 1.0 ELSE 0.0 END) AS pr FROM draws GROUP BY cell)
SELECT cell, CASE WHEN lt < 0.02 AND pr >= 0.5 THEN 'SHIP' WHEN lc < 0.02 AND pr < 0.5 THEN 'ABORT' ELSE 'CONTINUE' END AS decision FROM g""")
def q_decision(spark, sf):
    j = bayes.draws_summary(_draws(spark, sf), ["cell"])
    return j.select("cell", bayes.bayes_decision(C("loss_ship_treatment_rel"), C("loss_ship_control_rel"),
                                                 C("prob_treatment_better"), 0.02, 0.02).alias("decision"))


# --- planning -------------------------------------------------------------------------

CONV_BASE = f"WITH {S.CUST_UNITS}, base AS (SELECT c_mktsegment, avg(converted) AS baseline, count(*) AS n_units FROM units GROUP BY c_mktsegment), mdes AS (SELECT unnest([0.02, 0.05, 0.1, 0.9]) AS mde_relative)"
# The normal shift is solved in SQL by its own Newton steps.
ZA = repr(S.z(0.975))
SHIFT = f"""sh0 AS (SELECT {S.z(0.975) + S.z(0.8)!r} AS d),
sh1 AS (SELECT d - ((1 - {S.normal_tail(f'abs({ZA} - d)')}) + {S.normal_tail(f'({ZA} + d)')} - 0.8)
  / ((exp(-0.5*power({ZA} - d, 2)) - exp(-0.5*power({ZA} + d, 2)))/2.5066282746310002) AS d FROM sh0)"""


@query("power_proportion", f"""{CONV_BASE}, {SHIFT},
x AS (SELECT *, baseline*(1+mde_relative) AS p2 FROM base, mdes, sh1),
y AS (SELECT *, CASE WHEN p2 > 0 AND p2 < 1 THEN 2*(asin(sqrt(least(p2, 1.0))) - asin(sqrt(baseline))) END AS h FROM x)
SELECT c_mktsegment, {S.rnd('mde_relative')} AS mde_relative, {S.rnd('h')} AS cohens_h, CAST(ceil(2*d*d/(h*h)) AS BIGINT) AS sample_size_per_group,
  CASE WHEN h IS NULL THEN 'treatment_out_of_range' END AS error FROM y""")
def q_power_prop(spark, sf):
    b = planning.baselines(customer_units(spark, sf), ["c_mktsegment"], "converted")
    p = planning.power_proportion(planning.scenarios(b, mde_relative=[0.02, 0.05, 0.1, 0.9]))
    return p.select("c_mktsegment", rnd("mde_relative").alias("mde_relative"), rnd("cohens_h").alias("cohens_h"), "sample_size_per_group", "error")


VALUE_BASE = f"WITH {S.CUST_UNITS}, base AS (SELECT c_mktsegment, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n_units FROM units GROUP BY c_mktsegment)"


@query("power_mean", f"""{VALUE_BASE}, {SHIFT},
x AS (SELECT *, abs(m*mde_relative)/sd AS dd FROM base, (SELECT unnest([0.05, 0.1, 0.25]) AS mde_relative), sh1),
c AS (SELECT *, unnest(range(greatest(2, CAST(floor(2*d*d/(dd*dd)) AS BIGINT) - 2), CAST(floor(2*d*d/(dd*dd)) AS BIGINT) + 6)) AS n FROM x),
c1 AS (SELECT *, 2.0*n - 2 AS df, dd*sqrt(n/2.0) AS shift FROM c), {S.t_crit_ctes('c1', 'c2', 0.975)},
pw AS (SELECT *, {S.t_power('df', 'crit', 'shift')} AS pw FROM c2)
SELECT c_mktsegment, {S.rnd('mde_relative')} AS mde_relative, {S.rnd('any_value(dd)')} AS cohens_d, min(n) FILTER (WHERE pw >= 0.8) AS sample_size_per_group, NULL::VARCHAR AS error
FROM pw GROUP BY c_mktsegment, mde_relative""")
def q_power_mean(spark, sf):
    b = planning.baselines(customer_units(spark, sf), ["c_mktsegment"], "value")
    p = planning.power_mean(planning.scenarios(b, mde_relative=[0.05, 0.1, 0.25]))
    return p.select("c_mktsegment", rnd("mde_relative").alias("mde_relative"), rnd("cohens_d").alias("cohens_d"), "sample_size_per_group", "error")


@query("power_ratio", f"""WITH {S.CUST_RATIO}, b AS (SELECT c_mktsegment, avg(numerator) AS nm, avg(denominator) AS dm, stddev_samp(numerator) AS ns, stddev_samp(denominator) AS ds, corr(numerator, denominator) AS r FROM ratio_units GROUP BY c_mktsegment),
x AS (SELECT *, nm/dm AS ratio FROM b, (SELECT unnest([0.01, 0.05]) AS mde_relative)),
y AS (SELECT *, abs(ratio*mde_relative) AS mde_abs, (ns*ns + ratio*ratio*ds*ds - 2*ratio*r*ns*ds)/(dm*dm) AS v FROM x)
SELECT c_mktsegment, {S.rnd('mde_relative')} AS mde_relative, {S.rnd('ratio', 4)} AS baseline_ratio, {S.rnd('mde_abs', 4)} AS mde_absolute,
  CAST(ceil({(S.z(.975) + S.z(.8)) ** 2 * 2!r}*v/(mde_abs*mde_abs)) AS BIGINT) AS n_per_group, 'VIABLE' AS viability FROM y""")
def q_power_ratio(spark, sf):
    b = planning.ratio_baselines(customer_ratio(spark, sf), ["c_mktsegment"], "numerator", "denominator")
    p = planning.power_ratio(planning.scenarios(b, mde_relative=[0.01, 0.05]))
    return p.select("c_mktsegment", rnd("mde_relative").alias("mde_relative"), rnd("baseline_ratio", 4).alias("baseline_ratio"),
                    rnd("mde_absolute", 4).alias("mde_absolute"), "n_per_group", "viability")


@query("detectable_effect_proportion", f"""{CONV_BASE}, {SHIFT}, x AS (SELECT *, n_units//2 AS n FROM base, sh1)
SELECT c_mktsegment, n AS n_per_group, {S.rnd('power(sin(asin(sqrt(baseline)) + d*sqrt(2.0/n)/2), 2) - baseline')} AS mde_absolute,
  {S.rnd('(power(sin(asin(sqrt(baseline)) + d*sqrt(2.0/n)/2), 2) - baseline)/baseline')} AS mde_relative FROM x""")
def q_detectable(spark, sf):
    b = planning.baselines(customer_units(spark, sf), ["c_mktsegment"], "converted")
    b = b.withColumn("n_per_group", F.expr("n_units div 2"))
    return _rounded(planning.detectable_effect_proportion(b), ["c_mktsegment", "n_per_group"], {"mde_absolute": 6, "mde_relative": 6})


# The answer is checked by solving for it with SQL Newton steps on the same power sum.
def _dstep(src, out):
    h = 1e-4
    f = S.t_power("df", "crit", "(dd*sqrt(n/2.0))")
    g = S.t_power("df", "crit", f"((dd + {h})*sqrt(n/2.0))")
    return f"{out}_f AS (SELECT *, {f} AS f, {g} AS g FROM {src}), {out} AS (SELECT * EXCLUDE (f, g, dd), dd + (0.8 - f)/((g - f)/{h}) AS dd FROM {out}_f)"


@query("detectable_effect_mean", f"""{VALUE_BASE}, {SHIFT},
x0 AS (SELECT *, n_units//2 AS n, 2.0*(n_units//2) - 2 AS df, d*sqrt(2.0/(n_units//2)) AS dd FROM base, sh1), {S.t_crit_ctes('x0', 'x1', 0.975)},
{_dstep('x1', 'x2')}, {_dstep('x2', 'x3')}, {_dstep('x3', 'x4')}
SELECT c_mktsegment, n AS n_per_group, {S.rnd('dd')} AS cohens_d, {S.rnd('dd*sd', 1)} AS mde_absolute FROM x4""")
def q_detectable_mean(spark, sf):
    b = planning.baselines(customer_units(spark, sf), ["c_mktsegment"], "value").withColumn("n_per_group", F.expr("n_units div 2"))
    return _rounded(planning.detectable_effect_mean(b), ["c_mktsegment", "n_per_group"], {"cohens_d": 6, "mde_absolute": 1})


@query("power_sensitivity_table", f"""{CONV_BASE}, {SHIFT}, tr AS (SELECT unnest([50.0, 200.0, 1000.0]) AS daily_traffic),
y AS (SELECT *, 2*(asin(sqrt(baseline*(1+mde_relative))) - asin(sqrt(baseline))) AS h FROM base, (SELECT * FROM mdes WHERE mde_relative < 0.5), sh1),
s AS (SELECT *, CAST(ceil(2*d*d/(h*h)) AS BIGINT) AS n FROM y), g AS (SELECT *, CAST(ceil(2*n/daily_traffic) AS BIGINT) AS days FROM s, tr)
SELECT c_mktsegment, {S.rnd('mde_relative')} AS mde_relative, {S.rnd('daily_traffic')} AS daily_traffic, n AS sample_size_per_group, 2*n AS total_sample_size, days, {S.rnd('days/7.0', 1)} AS weeks,
  CASE WHEN days <= 28 THEN 'VIABLE' WHEN days <= 56 THEN 'MARGINAL' ELSE 'NOT_VIABLE' END AS viable FROM g""")
def q_sensitivity(spark, sf):
    b = planning.baselines(customer_units(spark, sf), ["c_mktsegment"], "converted")
    t = planning.power_sensitivity_table(b, [0.02, 0.05, 0.1], [50, 200, 1000])
    return t.select("c_mktsegment", rnd("mde_relative").alias("mde_relative"), rnd("daily_traffic").alias("daily_traffic"), "sample_size_per_group",
                    "total_sample_size", "days", rnd("weeks", 1).alias("weeks"), "viable")


@query("duration_estimate", f"""WITH {S.EVENTS}, u AS (SELECT experiment_id, count(DISTINCT unit_id)*1.0/count(DISTINCT CAST(event_at AS DATE)) AS daily FROM ev GROUP BY experiment_id),
d AS (SELECT *, CAST(ceil(400/(daily*0.5)) AS BIGINT) AS days FROM u)
SELECT experiment_id, days, {S.rnd('days/7.0', 1)} AS weeks, CASE WHEN days <= 28 THEN 'VIABLE' WHEN days <= 56 THEN 'MARGINAL' ELSE 'NOT_VIABLE' END AS viable FROM d""")
def q_duration(spark, sf):
    ev = event_facts(spark, sf)
    t = ev.groupBy("experiment_id").agg(
        (F.count_distinct("unit_id") / F.count_distinct(F.to_date("event_at"))).alias("daily_traffic"))
    d = planning.duration_estimate(t.withColumn("total_sample_size", F.lit(400)), allocation=0.5)
    return d.select("experiment_id", "days", rnd("weeks", 1).alias("weeks"), "viable")


@query("extension_estimate", f"""{UNIT_PAIRS}, x AS (SELECT *, mean_treatment - mean_control AS e FROM p),
r AS (SELECT *, CAST(ceil({(S.z(.975) + S.z(.8)) ** 2 * 2!r}*var_control/(e*e)) AS BIGINT) AS need FROM x),
a AS (SELECT *, greatest(0, need - n_control) AS more FROM r), d AS (SELECT *, CAST(ceil(more/10.0) AS BIGINT) AS days FROM a)
SELECT experiment_id, need AS required_n_per_group, more AS additional_n_needed, days AS additional_days, CAST(ceil(n_control/10.0) AS BIGINT) + days AS total_duration, days <= 56 AS feasible FROM d""")
def q_extension(spark, sf):
    p = _pairs(spark, sf, "value").select("experiment_id", C("n_control").alias("current_n"),
        (C("mean_treatment") - C("mean_control")).alias("observed_effect"), C("var_control").alias("baseline_variance"), F.lit(20.0).alias("daily_traffic"))
    return planning.extension_estimate(p).select("experiment_id", "required_n_per_group", "additional_n_needed", "additional_days", "total_duration", "feasible")


@query("assignment_surface", f"""WITH {S.EVENTS}, f AS (SELECT experiment_id, unit_id, min(event_at) AS t FROM ev GROUP BY ALL),
g AS (SELECT experiment_id, count(*) AS n_units, date_diff('day', min(t), max(t)) + 1 AS days FROM f GROUP BY experiment_id)
SELECT experiment_id, n_units, CAST(days AS INTEGER) AS days, {S.rnd('n_units*1.0/days')} AS units_per_day FROM g""")
def q_surface(spark, sf):
    s = planning.assignment_surface(event_facts(spark, sf), K, "unit_id", "event_at")
    return s.select("experiment_id", "n_units", "days", rnd("units_per_day").alias("units_per_day"))


# --- distribution functions -------------------------------------------------------------


@query("distribution_functions", f"""WITH x AS (SELECT c_custkey, c_acctbal/2500 AS z, c_nationkey + 3.0 AS df, abs(c_acctbal)/1000 AS c FROM customer)
SELECT c_custkey, {S.rnd(f"CASE WHEN z >= 0 THEN {S.normal_tail('abs(z)')} ELSE 1 - {S.normal_tail('abs(z)')} END")} AS normal_tail,
  {S.rnd(f"CASE WHEN z >= 0 THEN {S.t_tail('abs(z)', 'df')} ELSE 1 - {S.t_tail('abs(z)', 'df')} END")} AS t_tail,
  {S.rnd(S.chi_one('c'))} AS chi_1, {S.rnd('exp(-c/2)*(1 + c/2)')} AS chi_4 FROM x""")
def q_distributions(spark, sf):
    from ..functions import distributions as d
    x = spark.read.parquet(f"{sf}/customer.parquet").select(
        "c_custkey", (C("c_acctbal") / 2500).alias("z"), (C("c_nationkey") + 3.0).alias("df"), (F.abs("c_acctbal") / 1000).alias("c"))
    return x.select("c_custkey", rnd(d.norm_sf(C("z"))).alias("normal_tail"), rnd(d.t_sf(C("z"), C("df"))).alias("t_tail"),
                    rnd(d.chi2_sf(C("c"), F.lit(1))).alias("chi_1"), rnd(d.chi2_sf(C("c"), F.lit(4))).alias("chi_4"))
