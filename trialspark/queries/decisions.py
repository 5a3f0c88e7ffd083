"""Verdicts, monitoring, provenance, logs and configuration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import logs
from ..operators.segments import segment_moments
from ..operators.moments import pair_arms
from ..plans import analyze, monitor as mon, verdict as vd
from ..plans.experiments import customer_units, thinned_events
from ..session import materialize
from . import sql as S
from .ratio_and_bayes import DAY, _trend_sql
from .registry import query
from .tests_of_effect import K

C = F.col
TS_DAY = "yyyy-MM-dd"

# --- the ladder over every order: one synthetic reading per row -------------------


def ladder_rows(spark, sf):
    """Readings computed from order keys, with NULLs in every input."""
    k = C("o_orderkey")
    centre = ((k * 37) % 200 - 100) / 10.0
    half = ((k * 13) % 97 + 1) / 5.0
    half90 = half * 0.84
    lo = ((k * 3) % 50 - 45) / 10.0
    hi = ((k * 7) % 50 - 2) / 10.0

    def unless(mod, col):
        return F.when(k % mod != 0, col)

    rail = F.array(
        F.struct(F.lit("latency").alias("metric_name"), F.lit("lower_is_better").alias("direction"), lo.alias("ci_lower_90"), (lo + 3.0).alias("ci_upper_90")),
        F.struct(F.lit("revenue").alias("metric_name"), F.lit("higher_is_better").alias("direction"), (hi - 3.0).alias("ci_lower_90"), hi.alias("ci_upper_90")),
    )
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        k.alias("experiment_id"),
        unless(67, k % 11 != 0).alias("srm_pass"), (k % 22 == 0).alias("srm_override_resolved"),
        unless(71, rail).alias("guardrails"),
        unless(61, 10000 + (k * 7) % 20000).alias("n_observed"), F.lit(18000).cast("long").alias("n_required"),
        unless(53, centre - half).alias("primary_ci_lower_95"), (centre + half).alias("primary_ci_upper_95"),
        unless(47, centre - half90).alias("primary_ci_lower_90"), (centre + half90).alias("primary_ci_upper_90"),
        unless(59, centre).alias("primary_lift_magnitude"),
        F.when(k % 3 == 0, "higher_is_better").when(k % 3 == 1, "lower_is_better").otherwise("neither").alias("primary_direction"),
        unless(73, F.lit(2.0)).alias("mde_pct"), ((k % 3 + 1) * 100.0).alias("baseline"),
        F.when(k % 4 != 0, ((k * 17) % 150) / 100.0).alias("late_ratio"),
    )


LADDER = """lr AS (SELECT o_orderkey AS k, o_orderkey AS experiment_id, CASE WHEN o_orderkey % 67 <> 0 THEN o_orderkey % 11 <> 0 END AS srm_pass, o_orderkey % 22 = 0 AS ovr,
  CASE WHEN o_orderkey % 61 <> 0 THEN 10000 + (o_orderkey*7) % 20000 END AS n_obs, CAST(18000 AS BIGINT) AS n_req,
  CAST((o_orderkey*37) % 200 - 100 AS DOUBLE)/10 AS ce, CAST((o_orderkey*13) % 97 + 1 AS DOUBLE)/5 AS ha,
  CAST((o_orderkey*3) % 50 - 45 AS DOUBLE)/10 AS glo, CAST((o_orderkey*7) % 50 - 2 AS DOUBLE)/10 AS ghi,
  CASE o_orderkey % 3 WHEN 0 THEN 'higher_is_better' WHEN 1 THEN 'lower_is_better' ELSE 'neither' END AS dir,
  CASE WHEN o_orderkey % 73 <> 0 THEN 2.0::DOUBLE END AS mde_pct, CAST(o_orderkey % 3 + 1 AS DOUBLE)*100 AS baseline,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST((o_orderkey*17) % 150 AS DOUBLE)/100 END AS late FROM orders),
li AS (SELECT *, CASE WHEN k % 53 <> 0 THEN ce - ha END AS l95, ce + ha AS u95, CASE WHEN k % 47 <> 0 THEN ce - ha*0.84::DOUBLE END AS l90, ce + ha*0.84::DOUBLE AS u90,
  CASE WHEN k % 59 <> 0 THEN ce END AS lift, mde_pct/100*baseline AS mde, k % 71 = 0 AS noguard, (glo > 0 OR ghi < 0) AS viol FROM lr),
lb AS (SELECT *, (l95 <= 0 AND u95 >= 0) AS flat, NOT (l90 <= 0 AND u90 >= 0) AS ex90,
  CASE WHEN l95 <= 0 AND u95 >= 0 THEN FALSE WHEN dir = 'higher_is_better' THEN l95 > 0 WHEN dir = 'lower_is_better' THEN u95 < 0 ELSE TRUE END AS ben FROM li),
lv AS (SELECT *, CASE
  WHEN mde_pct IS NULL THEN 'UNVERIFIABLE:0:missing_input' WHEN srm_pass IS NULL THEN 'UNVERIFIABLE:1:missing_input' WHEN NOT srm_pass AND NOT ovr THEN 'INVALID-SRM:1:'
  WHEN noguard THEN 'UNVERIFIABLE:2:missing_input' WHEN viol THEN 'NO-SHIP-GUARDRAIL:2:' WHEN n_obs IS NULL OR l95 IS NULL THEN 'UNVERIFIABLE:3:missing_input'
  WHEN n_obs < n_req AND flat THEN 'INCONCLUSIVE:3:' WHEN flat AND (u95 - l95)/2 > 2*mde THEN 'NO-LIFT:4:' WHEN l90 IS NULL THEN 'UNVERIFIABLE:5:missing_input'
  WHEN flat AND ex90 THEN 'DIRECTIONAL-ONLY:5:' WHEN lift IS NULL THEN 'UNVERIFIABLE:6:missing_input' WHEN ben AND abs(lift) < 0.5*mde THEN 'LIFT-WITH-CAVEAT:6:small_lift'
  WHEN ben AND late < 0.7::DOUBLE THEN 'LIFT-WITH-CAVEAT:7:novelty' WHEN ben AND late IS NULL THEN 'SHIP:7:late_ratio_unavailable' WHEN ben THEN 'SHIP:7:'
  WHEN flat THEN 'LEARN:8:well_powered_null' ELSE 'LEARN:8:analysis_incomplete' END AS v FROM lb)"""


@query("walk_tree", f"""WITH {LADDER} SELECT experiment_id, split_part(v, ':', 1) AS verdict, CAST(split_part(v, ':', 2) AS INTEGER) AS terminal_step,
  nullif(split_part(v, ':', 3), '') AS reason FROM lv""")
def q_walk(spark, sf):
    return vd.walk_tree(ladder_rows(spark, sf)).select("experiment_id", "verdict", "terminal_step", "reason")


def _label(lo95, hi95, lo90, hi90, d):
    return f"""CASE WHEN {lo95} IS NULL OR {lo90} IS NULL THEN NULL
  WHEN {d} = 'neither' THEN CASE WHEN {lo95} > 0 OR {hi95} < 0 THEN 'highly likely positive' WHEN {lo90} > 0 OR {hi90} < 0 THEN 'very likely positive'
    WHEN abs(({lo90}+{hi90})/2) <= 0.05::DOUBLE*({hi90}-{lo90})/2 THEN 'inconclusive' ELSE 'leaning positive' END
  WHEN {d} = 'lower_is_better' THEN CASE WHEN {hi95} < 0 THEN 'highly likely positive' WHEN {hi90} < 0 THEN 'very likely positive' WHEN {lo95} > 0 THEN 'highly likely negative'
    WHEN {lo90} > 0 THEN 'very likely negative' WHEN abs(({lo90}+{hi90})/2) <= 0.05::DOUBLE*({hi90}-{lo90})/2 THEN 'inconclusive' WHEN {lo90}+{hi90} < 0 THEN 'leaning positive' ELSE 'leaning negative' END
  ELSE CASE WHEN {lo95} > 0 THEN 'highly likely positive' WHEN {lo90} > 0 THEN 'very likely positive' WHEN {hi95} < 0 THEN 'highly likely negative'
    WHEN {hi90} < 0 THEN 'very likely negative' WHEN abs(({lo90}+{hi90})/2) <= 0.05::DOUBLE*({hi90}-{lo90})/2 THEN 'inconclusive' WHEN {lo90}+{hi90} > 0 THEN 'leaning positive' ELSE 'leaning negative' END END"""


@query("map_confidence", f"WITH {LADDER} SELECT experiment_id, dir AS direction, {_label('l95', 'u95', 'l90', 'u90', 'dir')} AS label FROM li")
def q_confidence(spark, sf):
    r = ladder_rows(spark, sf)
    # Every seventh interval arrives reversed and must be swapped.
    flip = C("experiment_id") % 7 == 0
    lo, hi = C("primary_ci_lower_95"), C("primary_ci_upper_95")
    label = vd.map_confidence(F.when(flip, hi).otherwise(lo), F.when(flip, lo).otherwise(hi), C("primary_ci_lower_90"),
                              C("primary_ci_upper_90"), C("primary_direction"))
    return r.select("experiment_id", C("primary_direction").alias("direction"), label.alias("label"))


def _stored(spark, sf):
    """Stored reports: the true verdict, doctored for every tenth experiment."""
    w = vd.walk_tree(ladder_rows(spark, sf)).drop("guardrails_violated", "mde_absolute", "reason")
    return w.withColumn("verdict", F.when(C("experiment_id") % 10 == 0, "SHIP").otherwise(C("verdict")))


REPLAY = f"""{LADDER}, rp AS (SELECT *, split_part(v, ':', 1) AS truth, CASE WHEN k % 10 = 0 THEN 'SHIP' ELSE split_part(v, ':', 1) END AS stored,
  n_obs IS NULL OR mde_pct IS NULL AS cannot FROM lv), rr AS (SELECT *, CASE WHEN NOT cannot THEN truth = stored END AS reproduces FROM rp)"""


@query("verdict_replay", f"WITH {REPLAY} SELECT experiment_id, stored AS stored_verdict, truth AS verdict, reproduces FROM rr")
def q_replay(spark, sf):
    return vd.verdict_replay(_stored(spark, sf)).select("experiment_id", "stored_verdict", "verdict", "reproduces")


@query("render_status", f"""WITH {REPLAY}, h AS (SELECT *, CASE WHEN k % 13 <> 0 THEN sha256(CAST(k AS VARCHAR)) END AS live, CASE WHEN k % 17 = 0 THEN 'x' ELSE sha256(CAST(k AS VARCHAR)) END AS st FROM rr),
s AS (SELECT *, CASE WHEN live IS NULL THEN 'UNVERIFIABLE:hash_missing' WHEN reproduces IS NULL THEN 'UNVERIFIABLE:inputs_incomplete' WHEN live <> st THEN 'DRAFT_UNVERIFIED:hash_mismatch'
  WHEN NOT reproduces THEN 'DRAFT_UNVERIFIED:verdict_mismatch' ELSE 'VERIFIED:' END AS r FROM h)
SELECT split_part(r, ':', 1) AS render_status, nullif(split_part(r, ':', 2), '') AS status_reason, count(*) AS n FROM s GROUP BY ALL""")
def q_status(spark, sf):
    k = C("experiment_id")
    digest = F.sha2(k.cast("string"), 256)
    r = vd.verdict_replay(_stored(spark, sf)).withColumns(
        {"live": F.when(k % 13 != 0, digest), "stored_hash": F.when(k % 17 == 0, "x").otherwise(digest)})
    return vd.render_status(r, "live", "stored_hash").groupBy("render_status", "status_reason").agg(F.count(F.lit(1)).alias("n"))


# --- end to end ---------------------------------------------------------------------

RAIL_SIDES = {"orders": "higher_is_better", "pre_value": "higher_is_better"}


def _effects(spark, sf):
    return analyze.metric_effects(customer_units(spark, sf), K, ["value", "orders", "pre_value", "early_value", "late_value"])


def verdicts(spark, sf, effects=None):
    effects = _effects(spark, sf) if effects is None else effects
    inputs = analyze.tree_inputs(effects, K, "value", RAIL_SIDES, n_required=40, mde_pct=10.0,
                                 early="early_value", late="late_value")
    return analyze.decide(inputs)


def _effect_cte(m):
    return f"{S.moments(f'm_{m}', 'units', 'experiment_id', m)}, {S.pairs(f'p_{m}', f'm_{m}', 'experiment_id')}, {S.welch(f'w_{m}', f'p_{m}')}, {S.t_crit_ctes(f'w_{m}', f'x_{m}', 0.95, 'df', 'c90')}"


E2E = f"""WITH {S.CUST_UNITS}, {_effect_cte('value')}, {_effect_cte('orders')}, {_effect_cte('pre_value')},
el AS (SELECT experiment_id, avg(early_value) FILTER (WHERE arm = 'treatment') - avg(early_value) FILTER (WHERE arm = 'control') AS ee,
  avg(late_value) FILTER (WHERE arm = 'treatment') - avg(late_value) FILTER (WHERE arm = 'control') AS le FROM units GROUP BY experiment_id),
e0 AS (SELECT v.experiment_id, v.arm, v.n_control, v.n_treatment, v.n_control + v.n_treatment AS n_obs, v.ci_lower AS l95, v.ci_upper AS u95, v.diff - v.c90*v.se AS l90, v.diff + v.c90*v.se AS u90,
  v.diff AS lift, 0.1*v.mean_control AS mde, le/ee AS late, o.diff + o.c90*o.se AS g1, q.diff + q.c90*q.se AS g2,
  {S.chi_one('power(v.n_control - v.n_treatment, 2)*1.0/(v.n_control + v.n_treatment)')} AS srm_p
  FROM x_value v JOIN x_orders o USING (experiment_id) JOIN x_pre_value q USING (experiment_id) JOIN el USING (experiment_id)),
e1 AS (SELECT *, l95 <= 0 AND u95 >= 0 AS flat, l90 <= 0 AND u90 >= 0 AS flat90 FROM e0),
e2 AS (SELECT *, CASE WHEN srm_p <= 0.01 THEN 'INVALID-SRM:1:' WHEN g1 < 0 OR g2 < 0 THEN 'NO-SHIP-GUARDRAIL:2:' WHEN n_obs < 40 AND flat THEN 'INCONCLUSIVE:3:'
  WHEN flat AND (u95-l95)/2 > 2*mde THEN 'NO-LIFT:4:' WHEN flat AND NOT flat90 THEN 'DIRECTIONAL-ONLY:5:' WHEN l95 > 0 AND abs(lift) < 0.5*mde THEN 'LIFT-WITH-CAVEAT:6:small_lift'
  WHEN l95 > 0 AND late < 0.7 THEN 'LIFT-WITH-CAVEAT:7:novelty' WHEN l95 > 0 AND late IS NULL THEN 'SHIP:7:late_ratio_unavailable' WHEN l95 > 0 THEN 'SHIP:7:'
  WHEN flat THEN 'LEARN:8:well_powered_null' ELSE 'LEARN:8:analysis_incomplete' END AS v FROM e1)"""


@query("experiment_verdicts", f"""{E2E} SELECT experiment_id, arm, n_obs AS n_observed, {S.rnd('srm_p')} AS srm_p, {S.rnd('lift', 2)} AS lift, {S.rnd('l95', 1)} AS ci_lower_95, {S.rnd('u95', 1)} AS ci_upper_95,
  {S.rnd('late', 4)} AS late_ratio, split_part(v, ':', 1) AS verdict, CAST(split_part(v, ':', 2) AS INTEGER) AS terminal_step, nullif(split_part(v, ':', 3), '') AS reason,
  {_label('l95', 'u95', 'l90', 'u90', "'higher_is_better'")} AS confidence FROM e2""")
def q_verdicts(spark, sf):
    v = verdicts(spark, sf)
    return v.select("experiment_id", "arm", "n_observed", rnd("srm_p").alias("srm_p"), rnd("primary_lift_magnitude", 2).alias("lift"),
                    rnd("primary_ci_lower_95", 1).alias("ci_lower_95"), rnd("primary_ci_upper_95", 1).alias("ci_upper_95"),
                    rnd("late_ratio", 4).alias("late_ratio"), "verdict", "terminal_step", "reason", "confidence")


E2E_MISSING = E2E.replace(
    "FROM cust_assign a LEFT JOIN order_fold f ON a.unit_id = f.o_custkey)",
    "FROM cust_assign a LEFT JOIN order_fold f ON a.unit_id = f.o_custkey), all_units AS (SELECT * FROM units_), "
    "units AS (SELECT * REPLACE (CASE WHEN unit_id % 4 <> 1 THEN value END AS value) FROM all_units)",
).replace("units AS (\n  SELECT a.*", "units_ AS (\n  SELECT a.*").replace(
    S.chi_one("power(v.n_control - v.n_treatment, 2)*1.0/(v.n_control + v.n_treatment)"),
    S.chi_one("power(o.n_control - o.n_treatment, 2)*1.0/(o.n_control + o.n_treatment)"),
)


@query("verdicts_with_missing_values", f"""{E2E_MISSING} SELECT experiment_id, arm, n_obs AS n_observed, {S.rnd('srm_p')} AS srm_p, {S.rnd('lift', 2)} AS lift,
  split_part(v, ':', 1) AS verdict, CAST(split_part(v, ':', 2) AS INTEGER) AS terminal_step FROM e2""")
def q_verdicts_missing(spark, sf):
    """Half of the treated units have no value; the split of the units is what it was."""
    units = customer_units(spark, sf).withColumn("value", F.when(C("unit_id") % 4 != 1, C("value")))
    effects = analyze.metric_effects(units, K, ["value", "orders", "pre_value", "early_value", "late_value"])
    v = verdicts(spark, sf, effects)
    return v.select("experiment_id", "arm", "n_observed", rnd("srm_p").alias("srm_p"), rnd("primary_lift_magnitude", 2).alias("lift"), "verdict", "terminal_step")


def _findings(spark, sf):
    u = customer_units(spark, sf)
    eff = materialize(analyze.metric_effects(u, K, ["value", "orders", "converted", "early_value", "late_value"]), "effects")
    inputs = analyze.tree_inputs(eff, K, "value", {"orders": "higher_is_better"}, 60, 10.0, early="early_value", late="late_value")
    signs = eff.groupBy(*K).agg(
        F.array(*[F.signum(F.max(F.when(C("metric") == m, C("diff")))) for m in ("orders", "converted")]).alias("effect_signs"))
    seg = pair_arms(segment_moments(u, K, ["c_mktsegment"], "value"), [*K, "segment", "segment_value"])
    seg = seg.where(C("mean_control").isNotNull())
    seg_signs = seg.groupBy(*K).agg(F.collect_list(F.signum(C("mean_treatment") - C("mean_control"))).alias("segment_signs"))
    out = vd.walk_tree(inputs).join(signs, K, "left").join(seg_signs, K, "left")
    return out.withColumn("primary_effect", C("primary_lift_magnitude"))


@query("edge_case_flags", f"""WITH {S.CUST_UNITS}, {_effect_cte('orders')},
d AS (SELECT experiment_id, count(*) AS n, count(*) FILTER (WHERE arm = 'control') AS nc, {', '.join(f"avg({m}) FILTER (WHERE arm = 'treatment') - avg({m}) FILTER (WHERE arm = 'control') AS d_{m}" for m in ('value', 'orders', 'converted', 'early_value', 'late_value'))} FROM units GROUP BY experiment_id),
sg AS (SELECT experiment_id, c_mktsegment, avg(value) FILTER (WHERE arm = 'treatment') - avg(value) FILTER (WHERE arm = 'control') AS ds FROM units GROUP BY ALL),
s AS (SELECT experiment_id, list(sign(ds)) FILTER (WHERE ds IS NOT NULL) AS ss FROM sg GROUP BY experiment_id),
j AS (SELECT d.*, ss, x.diff + x.c90*x.se AS gu, {S.chi_one('power(2*nc - n, 2)*1.0/n')} AS srm_p FROM d JOIN s USING (experiment_id) JOIN x_orders x USING (experiment_id))
SELECT experiment_id, 'underpowered' AS name, CASE WHEN n < 60 THEN 'flagged' ELSE 'clear' END AS status FROM j
UNION ALL SELECT experiment_id, 'srm_violation', CASE WHEN srm_p <= 0.01 THEN 'blocking' ELSE 'clear' END FROM j
UNION ALL SELECT experiment_id, 'mixed_results', CASE WHEN d_orders*d_value < 0 OR d_converted*d_value < 0 THEN 'flagged' ELSE 'clear' END FROM j
UNION ALL SELECT experiment_id, 'guardrail_violation', CASE WHEN gu < 0 THEN 'blocking' ELSE 'clear' END FROM j
UNION ALL SELECT experiment_id, 'novelty_effect', CASE WHEN d_late_value/d_early_value < 0.7 THEN 'flagged' ELSE 'clear' END FROM j
UNION ALL SELECT experiment_id, 'simpsons_paradox', CASE WHEN len(list_filter(ss, lambda q: q*d_value >= 0)) = 0 THEN 'flagged' ELSE 'clear' END FROM j""")
def q_flags(spark, sf):
    return vd.edge_case_flags(_findings(spark, sf), K)


@query("report_metric_table", f"""{E2E}, al AS (
  SELECT experiment_id, 'value' AS name, 'primary' AS role, diff, lift_pct, ci_lower, ci_upper, diff - c90*se AS l90, diff + c90*se AS u90 FROM x_value UNION ALL
  SELECT experiment_id, 'orders', 'guardrail', diff, lift_pct, ci_lower, ci_upper, diff - c90*se, diff + c90*se FROM x_orders UNION ALL
  SELECT experiment_id, 'pre_value', 'control', diff, lift_pct, ci_lower, ci_upper, diff - c90*se, diff + c90*se FROM x_pre_value)
SELECT al.experiment_id, name, 'higher_is_better' AS direction, format('{{:+.4g}} ({{:+.1f}}%)', diff, lift_pct) AS lift, format('[{{:+.4g}}, {{:+.4g}}]', ci_lower, ci_upper) AS ci_95,
  format('[{{:+.4g}}, {{:+.4g}}]', al.l90, al.u90) AS ci_90, CASE WHEN role = 'primary' THEN split_part(v, ':', 1) ELSE 'clear' END AS status FROM al JOIN e2 USING (experiment_id)""")
def q_metric_table(spark, sf):
    # Verdicts and rows read the same few effects: stored, they come from one scan.
    stored = materialize(_effects(spark, sf), "effects")
    eff = stored.where(C("metric").isin("value", "orders", "pre_value"))
    role = F.when(C("metric") == "value", "primary").when(C("metric") == "orders", "guardrail").otherwise("control")
    v = verdicts(spark, sf, stored).select("experiment_id", "arm", "verdict")
    rows = eff.join(v, ["experiment_id", "arm"]).select(
        "experiment_id", role.alias("role"), C("metric").alias("name"), F.lit("higher_is_better").alias("direction"), "diff", "lift_pct",
        C("ci_lower").alias("ci_lower_95"), C("ci_upper").alias("ci_upper_95"), "ci_lower_90", "ci_upper_90", "verdict")
    return vd.report_metric_table(rows, K)


@query("sample_percent", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN CAST(round_even((o_orderkey % 500)*1.0/(o_orderkey % 9 * 50)*100, 0) AS INTEGER) END AS pct FROM orders")
def q_percent(spark, sf):
    k = C("o_orderkey")
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", vd.sample_percent(k % 500, k % 9 * 50).alias("pct"))


# --- monitoring ------------------------------------------------------------------------

NOW = "2024-02-01"
ACC = f"""acc AS (SELECT experiment_id, count(*) AS n, (epoch_us(max(l)) - epoch_us(min(f)))/86400000000.0 AS days FROM (
  SELECT experiment_id, unit_id, min(event_at) AS f, max(event_at) AS l FROM thin GROUP BY ALL) GROUP BY experiment_id)"""


@query("sample_accumulation", f"""WITH {S.EVENTS}, {ACC}, a AS (SELECT *, n/days AS rate, n/(need*1.0) AS frac FROM acc, (SELECT unnest([0, 140, 155, 200, 400]) AS need)),
b AS (SELECT *, CASE WHEN need > 0 THEN least(1.0, days/40.0) END AS ef FROM a),
c AS (SELECT *, frac/ef AS pace, greatest(0.0, need - n)/rate AS rem FROM b)
SELECT experiment_id, CAST(need AS INTEGER) AS required_n, n AS current_n, CASE WHEN need > 0 THEN {S.rnd('frac')} END AS fraction_complete, CASE WHEN need > 0 THEN {S.rnd('pace')} END AS pace_ratio,
  CASE WHEN need > 0 THEN {S.rnd('rem', 5)} END AS days_remaining, CASE WHEN need > 0 THEN strftime(TIMESTAMP '{NOW}' + to_microseconds(CAST(floor(rem*86400000000) AS BIGINT)), '%Y-%m-%d') END AS projected_completion,
  CASE WHEN need <= 0 THEN 'RED' WHEN frac >= 1 OR pace >= 0.8 THEN 'GREEN' WHEN pace >= 0.5 THEN 'YELLOW' ELSE 'RED' END AS traffic_light FROM c""")
def q_accumulation(spark, sf):
    base = mon.accrual(thinned_events(spark, sf), K, "unit_id", "event_at")
    base = base.withColumns({"required_n": F.explode(F.array(*[F.lit(v) for v in (0, 140, 155, 200, 400)])), "planned": F.lit(40.0)})
    s = mon.sample_accumulation(base, F.lit(NOW).cast("timestamp"), planned_days="planned")
    return s.select("experiment_id", "required_n", "current_n", rnd("fraction_complete").alias("fraction_complete"), rnd("pace_ratio").alias("pace_ratio"),
                    rnd("days_remaining", 5).alias("days_remaining"), F.date_format("projected_completion", "yyyy-MM-dd").alias("projected_completion"), "traffic_light")


@query("run_monitor", f"""WITH {S.EVENTS}, {_trend_sql(DAY)}, sv AS (SELECT experiment_id, CASE WHEN bool_or(verdict = 'BLOCK') THEN 'BLOCK' WHEN bool_or(verdict = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS srm_verdict FROM wv GROUP BY experiment_id),
{S.moments('m', 'thin', 'experiment_id', 'value')}, {S.pairs('p', 'm', 'experiment_id')}, {S.welch('wl', 'p')},
gv AS (SELECT experiment_id, CASE WHEN ci_lower < -0.02*abs(mean_control) THEN 'BLOCK' WHEN diff < 0 AND p_value < 0.05 THEN 'WARNING' ELSE 'PASS' END AS guardrail_verdict FROM wl),
{ACC}, pv AS (SELECT experiment_id, CASE WHEN n >= 200 OR n/200.0/least(1.0, days/40.0) >= 0.8 THEN 'PASS' WHEN n/200.0/least(1.0, days/40.0) >= 0.5 THEN 'WARNING' ELSE 'BLOCK' END AS sample_verdict FROM acc),
j AS (SELECT * FROM sv JOIN gv USING (experiment_id) JOIN pv USING (experiment_id)),
k AS (SELECT *, list_concat(list_transform(['BLOCK', 'WARNING'], lambda l: CASE WHEN srm_verdict = l THEN 1 ELSE 0 END), list_transform(['BLOCK', 'WARNING'], lambda l: CASE WHEN guardrail_verdict = l THEN 1 ELSE 0 END)) AS x FROM j)
SELECT experiment_id, srm_verdict, guardrail_verdict, sample_verdict, CASE WHEN 'BLOCK' IN (srm_verdict, guardrail_verdict, sample_verdict) THEN 'RED' WHEN 'WARNING' IN (srm_verdict, guardrail_verdict, sample_verdict) THEN 'YELLOW' ELSE 'GREEN' END AS status,
  CAST(greatest(1, (srm_verdict <> 'PASS')::INT + (guardrail_verdict <> 'PASS')::INT + (sample_verdict <> 'PASS')::INT) AS INTEGER) AS n_recommendations FROM k""")
def q_monitor(spark, sf):
    rails = {"value": {"nim": 0.02, "direction": "decrease", "type": "continuous"}}
    m = mon.run_monitor(thinned_events(spark, sf), K, "unit_id", "event_at", rails, 200, F.lit(NOW).cast("timestamp"), planned_days=40.0)
    return m.select("experiment_id", "srm_verdict", "guardrail_verdict", "sample_verdict", "status", F.size("recommendations").alias("n_recommendations"))


@query("worst_light", """SELECT light, count(*) AS n FROM (SELECT CASE WHEN greatest(a, b) = 0 THEN 'GREEN' WHEN greatest(a, b) = 1 THEN 'YELLOW' ELSE 'RED' END AS light FROM (
  SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS a, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END AS b FROM orders)) GROUP BY light""")
def q_lights(spark, sf):
    a = F.when(C("o_orderstatus") == "F", "PASS").when(C("o_orderstatus") == "O", "WARNING").otherwise("odd")
    b = F.when(C("o_orderpriority") == "1-URGENT", "BLOCK").when(C("o_orderpriority") == "2-HIGH", "WARNING").otherwise("PASS")
    light = mon.worst_light(mon.verdict_to_light(a), mon.verdict_to_light(b))
    return spark.read.parquet(f"{sf}/orders.parquet").groupBy(light.alias("light")).agg(F.count(F.lit(1)).alias("n"))


# --- logs ---------------------------------------------------------------------------------

def conversation_log(spark, sf):
    """Conversations as append-only logs: turn is the position, text the payload."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(C("conv_id").alias("experiment_id"), C("turn").alias("seq"), "role", "text")
    linked = logs.with_previous(c, "experiment_id", "seq", {"_h": F.sha2(logs.canonical(["role", "text"]), 256)})
    tampered = (C("experiment_id") % 7 == 3) & (C("seq") == 2)
    prev = F.when(tampered, F.sha2(F.lit("other"), 256)).otherwise(F.coalesce(C("_h"), F.lit("genesis")))
    states = F.array(*[F.lit(s) for s in logs.LIFECYCLE_STATES])
    pick = ((C("experiment_id") * 3 + C("seq") * (C("seq") + C("experiment_id") % 2)) % 11).cast("int")
    return linked.select("experiment_id", "seq", "role", "text", prev.alias("prev_hash"), states[pick].alias("status"),
                         F.when(C("experiment_id") % 3 == 0, "scope change").alias("reason"))


LOG = """lg AS (SELECT conv_id AS experiment_id, turn AS seq, role, text, sha256(coalesce(length(role) || ':' || role, '-') || coalesce(length(text) || ':' || text, '-')) AS h,
  ['DESIGNING', 'POWERED', 'COLLECTING', 'ANALYZING', 'INTERPRETED', 'REPORTED', 'SHIPPED', 'COMPLETED', 'ABANDONED', 'INVALID', 'BLOCKED'][1 + (conv_id*3 + turn*(turn + conv_id % 2)) % 11] AS status FROM conversations),
lh AS (SELECT *, lag(h) OVER (PARTITION BY experiment_id ORDER BY seq) AS ph, lag(status) OVER (PARTITION BY experiment_id ORDER BY seq) AS ps FROM lg),
lc AS (SELECT *, CASE WHEN experiment_id % 7 = 3 AND seq = 2 THEN sha256('other') ELSE coalesce(ph, 'genesis') END AS prev_hash FROM lh)"""


@query("chain_check", f"""WITH {LOG} SELECT experiment_id, count(*) AS n_entries, count(*) FILTER (WHERE prev_hash <> coalesce(ph, 'genesis')) AS n_breaks,
  min(seq) FILTER (WHERE prev_hash <> coalesce(ph, 'genesis')) AS first_break, count(*) FILTER (WHERE prev_hash <> coalesce(ph, 'genesis')) = 0 AS chain_ok FROM lc GROUP BY experiment_id""")
def q_chain(spark, sf):
    return logs.chain_check(conversation_log(spark, sf), "experiment_id", "seq", "prev_hash", ["role", "text"])


FWD = "('DESIGNING>POWERED','DESIGNING>ABANDONED','DESIGNING>BLOCKED','POWERED>COLLECTING','POWERED>ABANDONED','POWERED>BLOCKED','COLLECTING>ANALYZING','COLLECTING>ABANDONED','COLLECTING>BLOCKED','ANALYZING>INTERPRETED','ANALYZING>INVALID','ANALYZING>ABANDONED','INTERPRETED>REPORTED','INTERPRETED>ABANDONED','REPORTED>SHIPPED','REPORTED>ABANDONED','SHIPPED>COMPLETED','SHIPPED>ABANDONED','BLOCKED>DESIGNING','BLOCKED>POWERED','BLOCKED>COLLECTING','BLOCKED>ABANDONED')"
BWD = "('POWERED>DESIGNING','ANALYZING>COLLECTING','INTERPRETED>COLLECTING','INVALID>DESIGNING','INVALID>ABANDONED')"


@query("lifecycle_check", f"""WITH {LOG}, t AS (SELECT *, CASE WHEN ps IS NULL THEN 'first' WHEN ps = status THEN 'same' WHEN ps || '>' || status IN {BWD} THEN 'backward' WHEN ps || '>' || status IN {FWD} THEN 'forward' ELSE 'illegal' END AS transition FROM lc)
SELECT experiment_id, seq, ps AS previous_status, status, transition, transition IN ('first', 'same', 'forward') OR (transition = 'backward' AND experiment_id % 3 = 0) AS allowed,
  CASE WHEN transition = 'illegal' THEN 'illegal_transition' WHEN transition = 'backward' AND experiment_id % 3 <> 0 THEN 'missing_reason' END AS problem FROM t""")
def q_lifecycle(spark, sf):
    c = logs.lifecycle_check(conversation_log(spark, sf), "experiment_id", "seq", "status", "reason")
    return c.select("experiment_id", "seq", "previous_status", "status", "transition", "allowed", "problem")


@query("log_diff", """WITH a AS (SELECT conv_id // 2 AS pair, turn AS seq, text AS m FROM conversations WHERE conv_id % 2 = 0), b AS (SELECT conv_id // 2 AS pair, turn AS seq, text AS m FROM conversations WHERE conv_id % 2 = 1)
SELECT coalesce(a.pair, b.pair) AS pair, coalesce(a.seq, b.seq) AS seq, CASE WHEN a.pair IS NULL THEN 'only_in_b' WHEN b.pair IS NULL THEN 'only_in_a' ELSE 'changed' END AS kind, a.m AS message_a, b.m AS message_b
FROM a FULL JOIN b ON a.pair = b.pair AND a.seq = b.seq WHERE a.m IS NULL OR b.m IS NULL OR a.m <> b.m""")
def q_log_diff(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(F.expr("conv_id div 2").alias("pair"), C("turn").alias("seq"), "text", "conv_id")
    d = logs.log_diff(c.where("conv_id % 2 = 0"), c.where("conv_id % 2 = 1"), ["pair"], "seq", "text")
    return d.select("pair", "seq", "kind", "message_a", "message_b")


def _catalog(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    status = F.when(C("o_orderpriority") == "5-LOW", None).when(C("o_orderstatus") == "F", "VERIFIED").when(C("o_orderstatus") == "O", "DRAFT_UNVERIFIED").otherwise("UNVERIFIABLE")
    return o.select(C("o_custkey").alias("experiment_id"), status.alias("status"), C("o_orderpriority").alias("kind"), C("o_orderdate").cast("timestamp").alias("at"), "o_orderkey")


@query("catalog_index", """WITH c AS (SELECT o_custkey AS experiment_id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS r, o_orderpriority, o_orderdate, o_orderkey FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY o_orderdate DESC, o_orderkey DESC) AS i FROM c WHERE r IS NOT NULL),
g AS (SELECT experiment_id, count(r) AS n_renders, max(r) AS w FROM c GROUP BY experiment_id)
SELECT g.experiment_id, n_renders, CASE w WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'DRAFT_UNVERIFIED' ELSE 'UNVERIFIABLE' END AS worst_status, l.o_orderpriority AS latest_type, strftime(l.o_orderdate, '%Y-%m-%d') AS latest_at
FROM g LEFT JOIN l ON g.experiment_id = l.experiment_id AND i = 1""")
def q_index(spark, sf):
    i = logs.catalog_index(_catalog(spark, sf), "experiment_id", "status", "kind", "at", ["at", "o_orderkey"])
    return i.select("experiment_id", "n_renders", "worst_status", "latest_type", F.date_format("latest_at", "yyyy-MM-dd").alias("latest_at"))


PATHS = ["experiment.metrics.primary", "experiment.owner", "variants[0].weight", "data.tags[1]", "timeline.start", "id"]


def _configs(spark, sf):
    """Two versions of a configuration per part, as (path, value) rows."""
    p = spark.read.parquet(f"{sf}/part.parquet").withColumn("experiment_id", C("p_partkey"))
    k = C("p_partkey")
    values = [C("p_brand"), C("p_type"), C("p_size").cast("string"), C("p_name"), k.cast("string"), k.cast("string")]
    before = F.array_compact(F.array(*[F.when(k % (i + 2) != 0, F.struct(F.lit(n).alias("path"), v.alias("value"))) for i, (n, v) in enumerate(zip(PATHS, values))]))
    after = F.array_compact(F.array(*[F.when(k % (i + 3) != 0, F.struct(F.lit(n).alias("path"), F.when(k % (i + 4) == 0, F.concat(v, F.lit("*"))).otherwise(v).alias("value")))
                                      for i, (n, v) in enumerate(zip(PATHS, values))]))
    return p.select("experiment_id", F.inline(before)), p.select("experiment_id", F.inline(after))


VALUES = ["p_brand", "p_type", "CAST(p_size AS VARCHAR)", "p_name", "CAST(p_partkey AS VARCHAR)", "CAST(p_partkey AS VARCHAR)"]
CONFIG = "cb AS (" + " UNION ALL ".join(f"SELECT p_partkey AS id, '{n}' AS path, {v} AS value FROM part WHERE p_partkey % {i + 2} <> 0" for i, (n, v) in enumerate(zip(PATHS, VALUES))) + \
    "), ca AS (" + " UNION ALL ".join(f"SELECT p_partkey AS id, '{n}' AS path, CASE WHEN p_partkey % {i + 4} = 0 THEN {v} || '*' ELSE {v} END AS value FROM part WHERE p_partkey % {i + 3} <> 0" for i, (n, v) in enumerate(zip(PATHS, VALUES))) + \
    """), cd AS (SELECT coalesce(b.id, a.id) AS experiment_id, coalesce(b.path, a.path) AS path, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' ELSE 'changed' END AS op, b.value AS before, a.value AS after,
  CASE WHEN coalesce(b.path, a.path) IN ('experiment.metrics.primary', 'variants[0].weight') THEN 'material' ELSE 'administrative' END AS change_class
  FROM cb b FULL JOIN ca a ON b.id = a.id AND b.path = a.path WHERE b.id IS NULL OR a.id IS NULL OR a.value <> b.value)"""


@query("config_diff", f"WITH {CONFIG} SELECT * FROM cd")
def q_config_diff(spark, sf):
    b, a = _configs(spark, sf)
    return logs.config_diff(b, a, ["experiment_id"]).select("experiment_id", "path", "op", "before", "after", "change_class")


@query("flatten_config", """SELECT event_id, 'k' AS path, regexp_extract(props, '[0-9]+') AS value FROM events""")
def q_flatten(spark, sf):
    return logs.flatten_config(spark.read.parquet(f"{sf}/events.parquet"), ["event_id"], "props")


@query("amendments", f"WITH {CONFIG} SELECT experiment_id, path, op FROM cd WHERE change_class = 'material'")
def q_amendments(spark, sf):
    b, a = _configs(spark, sf)
    d = logs.config_diff(b, a, ["experiment_id"])
    return logs.amendments(d, ["experiment_id"], "path", material_only=True).select("experiment_id", "path", "op")


@query("experiment_state", """WITH f AS (SELECT o_custkey AS experiment_id, bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS rep, bool_or(o_orderpriority = '2-HIGH') AS ana, bool_or(o_orderpriority = '3-MEDIUM') AS sealed,
  bool_or(o_orderpriority = '4-NOT SPECIFIED') AS br, bool_or(o_orderpriority = '5-LOW') AS hyp FROM orders GROUP BY 1)
SELECT experiment_id, CASE WHEN rep THEN 'complete' WHEN sealed AND ana THEN 'analysis_in_progress' WHEN sealed THEN 'brief_sealed' WHEN br THEN 'brief_drafted' WHEN hyp THEN 'hypothesis_drafted' ELSE 'intent_only' END AS state FROM f""")
def q_state(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    p = C("o_orderpriority")
    artifact = (F.when((p == "1-URGENT") & (C("o_orderstatus") == "F"), "report").when(p == "2-HIGH", "analysis").when(p == "3-MEDIUM", "sealed_brief")
                .when(p == "4-NOT SPECIFIED", "brief").when(p == "5-LOW", "hypothesis"))
    return logs.experiment_state(o.select(C("o_custkey").alias("experiment_id"), artifact.alias("artifact")), "experiment_id", "artifact")
