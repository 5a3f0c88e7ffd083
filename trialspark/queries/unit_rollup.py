"""Monitoring and sequential looks on units, from one rollup of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..plans import rollup as ru
from ..plans.experiments import event_facts, thinned_events
from ..session import materialize
from . import sql as S
from .decisions import NOW
from .ratio_and_bayes import CUM, DAY, PATH, _trend_sql
from .registry import query
from .tests_of_effect import K

C = F.col
MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("unit_days", f"""WITH {S.EVENTS} SELECT experiment_id, unit_id, arm, strftime(event_at, '%Y-%m-%d') AS day, strftime(min(event_at), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(event_at), '%Y-%m-%d %H:%M:%S.%f') AS last_at,
  count(*) AS n_rows, count(value) AS value__n, {S.rnd('sum(value)', 4)} AS value__sum FROM thin GROUP BY ALL""")
def q_unit_days(spark, sf):
    """Two halves of the events rolled up apart and merged."""
    ev = thinned_events(spark, sf)
    halves = [ru.unit_days(ev.where(C("event_id") % 2 == i), K, ["value"]) for i in (0, 1)]
    r = ru.merge_unit_days(halves, K)
    return r.select("experiment_id", "unit_id", "arm", F.date_format("day", "yyyy-MM-dd").alias("day"), F.date_format("first_at", MICROS).alias("first_at"),
                    F.date_format("last_at", MICROS).alias("last_at"), "n_rows", "value__n", rnd("value__sum", 4).alias("value__sum"))


@query("run_monitor_units", f"""WITH {S.EVENTS}, tu AS (SELECT experiment_id, unit_id, arm, min(event_at) AS event_at, max(event_at) AS l, sum(value) AS value FROM thin GROUP BY ALL),
{_trend_sql(DAY).replace('thin', 'tu')}, sv AS (SELECT experiment_id, CASE WHEN bool_or(verdict = 'BLOCK') THEN 'BLOCK' WHEN bool_or(verdict = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS srm_verdict FROM wv GROUP BY experiment_id),
{S.moments('m', 'tu', 'experiment_id', 'value')}, {S.pairs('p', 'm', 'experiment_id')}, {S.welch('wl', 'p')},
gv AS (SELECT experiment_id, CASE WHEN ci_lower < -0.02*abs(mean_control) THEN 'BLOCK' WHEN diff < 0 AND p_value < 0.05 THEN 'WARNING' ELSE 'PASS' END AS guardrail_verdict FROM wl),
acc AS (SELECT experiment_id, count(*) AS n, (epoch_us(max(l)) - epoch_us(min(event_at)))/86400000000.0 AS days FROM tu GROUP BY experiment_id),
pv AS (SELECT *, CASE WHEN n >= 200 OR n/200.0/least(1.0, days/40.0) >= 0.8 THEN 'PASS' WHEN n/200.0/least(1.0, days/40.0) >= 0.5 THEN 'WARNING' ELSE 'BLOCK' END AS sample_verdict FROM acc)
SELECT experiment_id, n AS n_units, 0::BIGINT AS n_conflicts, {S.rnd('n/200.0')} AS fraction_complete, srm_verdict, guardrail_verdict, sample_verdict,
  CASE WHEN 'BLOCK' IN (srm_verdict, guardrail_verdict, sample_verdict) THEN 'RED' WHEN 'WARNING' IN (srm_verdict, guardrail_verdict, sample_verdict) THEN 'YELLOW' ELSE 'GREEN' END AS status
FROM sv JOIN gv USING (experiment_id) JOIN pv USING (experiment_id)""")
def q_monitor_units(spark, sf):
    rails = {"value": {"nim": 0.02, "direction": "decrease", "type": "continuous", "fold": "sum"}}
    days = ru.unit_days(thinned_events(spark, sf), K, ["value"])
    m = ru.monitor_units(days, K, rails, 200, F.lit(NOW).cast("timestamp"), planned_days=40.0)
    return m.select("experiment_id", "n_units", "n_conflicts", rnd("fraction_complete").alias("fraction_complete"), "srm_verdict", "guardrail_verdict", "sample_verdict", "status")


# Brute force: at every look, every unit's sum of all its rows so far.
UNIT_CUM = f"""WITH {S.EVENTS}, days AS (SELECT DISTINCT experiment_id, CAST(event_at AS DATE) AS look FROM ev),
u AS (SELECT d.experiment_id, d.look, e.arm, e.unit_id, sum(e.value) AS value FROM days d JOIN ev e ON e.experiment_id = d.experiment_id AND CAST(e.event_at AS DATE) <= d.look GROUP BY ALL),
m AS (SELECT experiment_id, look, arm, count(*) AS n, avg(value) AS mean, var_samp(value) AS var, sum(value) AS total FROM u GROUP BY ALL)"""


@query("sequential_path_units", f"""{PATH.replace(CUM, UNIT_CUM)}
SELECT experiment_id, strftime(look, '%Y-%m-%d') AS day, CAST(look_no AS INTEGER) AS look_no, n_control, n_treatment, {S.rnd('diff', 4)} AS diff, {S.rnd('radius', 3)} AS radius, decision,
  strftime(min(look) FILTER (WHERE decision = 'STOP_REJECT') OVER (PARTITION BY experiment_id, arm), '%Y-%m-%d') AS first_stop FROM x""")
def q_path_units(spark, sf):
    days = materialize(ru.unit_days(event_facts(spark, sf), K, ["value"]), "unit-days")
    p = ru.sequential_units(days, K, "value")
    return p.select("experiment_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "look_no", C("n_control").cast("long").alias("n_control"),
                    C("n_treatment").cast("long").alias("n_treatment"), rnd("diff", 4).alias("diff"), rnd("radius", 3).alias("radius"), "decision",
                    F.date_format("first_stop", "yyyy-MM-dd").alias("first_stop"))
