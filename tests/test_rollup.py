"""The unit-day rollup against plain loops over the events."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.plans import rollup as ru

C = F.col
K = ["k"]
SCHEMA = "k string, unit_id long, arm string, event_at timestamp, value double"
START = datetime(2024, 3, 1)
NOW = "2024-03-20"
RAILS = {"value": {"nim": 0.02, "direction": "decrease", "type": "continuous"}}


def events(seed=5, n=3000):
    """One unit has a third of all rows; some units change arms; every column has NULLs."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        unit = 0 if i % 3 == 0 else rng.randrange(1, 160)
        arm = "control" if unit % 2 == 0 else "treatment"
        if unit % 23 == 7 and i % 2:
            arm = "other"
        rows.append((rng.choice(["e1", "e1", "e2", None]), unit if rng.random() > 0.02 else None, arm if rng.random() > 0.03 else None,
                     START + timedelta(seconds=rng.randrange(12 * 86400)) if rng.random() > 0.02 else None, rng.gauss(1000, 3) if rng.random() > 0.1 else None))
    return rows


def by_unit(rows, until=None):
    """(key, unit) -> (arms, times, values) of the usable rows up to a day."""
    out = defaultdict(lambda: (set(), [], []))
    for k, unit, arm, at, value in rows:
        if unit is None or at is None or (until is not None and at.date() > until):
            continue
        arms, times, values = out[(k, unit)]
        arms |= {arm} - {None}
        times.append(at)
        values += [] if value is None else [value]
    return out


@pytest.fixture(scope="module")
def rows():
    return events()


@pytest.fixture(scope="module")
def days(spark, rows):
    return ru.unit_days(spark.createDataFrame(rows, SCHEMA).repartition(6), K, ["value"]).cache()


def test_parts_merge_to_the_whole(spark, rows, days):
    parts = [ru.unit_days(spark.createDataFrame(part, SCHEMA), K, ["value"]) for part in (rows[:10], rows[10:1800], [], rows[1800:])]
    key = lambda r: (r.k is None, r.k or "", r.unit_id, r.arm or "", r.day)
    merged = sorted(ru.merge_unit_days(parts, K).collect(), key=key)
    whole = sorted(days.collect(), key=key)
    assert merged[0].__fields__ == whole[0].__fields__ and len(merged) == len(whole)
    for a, b in zip(merged, whole):
        assert tuple(a)[:-1] == tuple(b)[:-1] and a.value__sum == (b.value__sum if b.value__sum is None else pytest.approx(b.value__sum, rel=1e-12))
    assert sum(r.n_rows for r in whole) == sum(1 for r in rows if r[1] is not None and r[3] is not None)


@pytest.mark.parametrize("fold", ["sum", "mean", "any"])
def test_units_equal_a_plain_loop(rows, days, fold):
    expected = by_unit(rows)
    got = {(r.k, r.unit_id): r for r in ru.unit_values(days, K, {"value": fold}).collect()}
    assert set(got) == set(expected)
    for key, (arms, times, values) in expected.items():
        r = got[key]
        want = {"sum": sum(values), "mean": np.mean(values) if values else None, "any": float(sum(values) > 0)}[fold]
        assert r.value == (want if want is None else pytest.approx(want))
        assert r.conflict == (len(arms) > 1) and r.arm == (next(iter(arms)) if len(arms) == 1 else None)
        assert (r.first_at, r.last_at) == (min(times), max(times))
    assert any(r.conflict for r in got.values())


def test_looks_equal_sums_over_all_earlier_rows(rows, days):
    """Values far from 0 and close together: the variances survive the differences of squares."""
    # A unit counts under the arm it was seen in; without rows that name an arm it counts nowhere.
    armed = [r for r in rows if r[2] is not None]
    final = by_unit(armed)
    got = ru.unit_look_stats(days, K, "value").collect()
    assert {r.k for r in got} == {"e1", "e2", None}
    for r in got:
        totals = [sum(v) for (k, u), (_, _, v) in by_unit(armed, r.day).items() if k == r.k and final[(k, u)][0] == {r.arm}]
        assert r.n == len(totals) and r.total == pytest.approx(sum(totals)) and r["mean"] == pytest.approx(np.mean(totals))
        assert r["var"] == (pytest.approx(np.var(totals, ddof=1), rel=1e-6) if len(totals) > 1 else None)


def test_a_busy_unit_is_one_unit(spark):
    """A thousand rows of one unit stop nothing: rows are no sample."""
    rows = [("e", 1, "treatment", START + timedelta(minutes=i), 5.0 + i % 2) for i in range(1000)]
    rows += [("e", 2 * u, "control", START + timedelta(days=u), 1.0) for u in range(1, 4)]
    days = ru.unit_days(spark.createDataFrame(rows, SCHEMA), K, ["value"])
    path = ru.sequential_units(days, K, "value").collect()
    assert path and all(r.decision != "STOP_REJECT" and r.n_treatment == 1 for r in path)
    (r,) = ru.monitor_units(days, K, RAILS, 100, F.lit(NOW).cast("timestamp")).collect()
    assert (r.n_units, r.n_conflicts, r.current_n) == (4, 0, 4) and r.fraction_complete == 0.04


def test_monitor_takes_a_count_and_keeps_every_experiment(rows, days):
    n = F.when(C("k") == "e1", 500).otherwise(C("n_units"))
    got = {r.k: r for r in ru.monitor_units(days, K, {**RAILS, "absent": {"nim": 0.1}}, 200, F.lit(NOW).cast("timestamp"), current_n=n, planned_days=20.0).collect()}
    units = by_unit(rows)
    assert set(got) == {"e1", "e2", None}
    for k, r in got.items():
        assert r.n_units == sum(1 for x, _ in units if x == k) and r.n_conflicts == sum(1 for (x, _), v in units.items() if x == k and len(v[0]) > 1)
        assert r.current_n == (500 if k == "e1" else r.n_units) and r.srm_verdict and r.checked_at == datetime(2024, 3, 20)
    # An absent metric is a warning at least, not a crash.
    assert got["e1"].sample_verdict == "PASS" and all("absent" in r.flagged_metrics for r in got.values())


def test_late_days_change_what_earlier_ones_said(spark, rows, days):
    """A late row merged in gives the result of a rollup that had it from the start."""
    late = [("e1", 1000, "control", START - timedelta(days=2), 7.0)]
    merged = ru.merge_unit_days([days, ru.unit_days(spark.createDataFrame(late, SCHEMA), K, ["value"])], K)
    (r,) = ru.unit_values(merged, K, {"value": "sum"}).where("unit_id = 1000").collect()
    assert r.first_at == START - timedelta(days=2) and r.value == 7.0
    assert ru.unit_look_stats(merged, K, "value").where("k = 'e1'").agg(F.min("day")).first()[0] == (START - timedelta(days=2)).date()


def test_empty_and_refused(spark, days):
    empty = ru.unit_days(spark.createDataFrame([], SCHEMA), K, ["value"])
    assert empty.count() == 0 and ru.monitor_units(empty, K, RAILS, 100, F.lit(NOW).cast("timestamp")).count() == 0 and ru.sequential_units(empty, K, "value").count() == 0
    nulls = ru.unit_days(spark.createDataFrame([(None, None, None, None, None)], SCHEMA), K, ["value"])
    assert nulls.count() == 0
    with pytest.raises(ValueError, match="folds"):
        ru.unit_values(days, K, {"value": "median"})
    with pytest.raises(ValueError, match="rollup columns"):
        ru.unit_days(spark.createDataFrame([], "k string, unit_id long, arm string, event_at timestamp, day double"), K, ["day"])
    with pytest.raises(ValueError, match="merge"):
        ru.merge_unit_days([], K)


def test_events_are_scanned_once(spark, sf):
    plan = ru.unit_days(
        spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type AS k", "user_id AS unit_id", "'a' AS arm", "ts AS event_at", "value"), K, ["value"]
    )._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "props" not in plan
