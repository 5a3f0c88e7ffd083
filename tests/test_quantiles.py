"""Exact quantiles against numpy: hot keys, ties, infinities, NULL keys, wrong sketches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import quantiles
from trialspark.operators.quantiles import attach_quantiles, exact_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]


def want(values, probs=PROBS):
    return [float(x) for x in np.quantile(np.array(values, float), probs)]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with nine tenths of all rows, ties and far outliers; a small key, a NULL key, one without values."""
    rng = np.random.default_rng(5)
    hot = np.concatenate([rng.lognormal(0, 3, 40000), np.full(9000, 2.5), np.full(4000, 7.0), [1e300, -1e300]])
    rows = [("hot", float(x)) for x in hot] + [("small", float(i)) for i in range(7)] + [(None, float(x)) for x in hot[:3000]]
    rows += [("none", None), ("none", float("nan")), ("one", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    groups = {"hot": hot, "small": range(7), None: hot[:3000], "one": [4.0]}
    return df, {k: want(list(g)) for k, g in groups.items()}


@pytest.mark.parametrize("gather, accuracy", [(1 << 16, None), (50, None), (50, 4), (16, 100)])
def test_equals_numpy_for_any_bound(skewed, gather, accuracy):
    df, expected = skewed
    got = {r.k: list(r.q) for r in exact_quantiles(df, ["k"], "v", PROBS, gather=gather, accuracy=accuracy).collect()}
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k] == pytest.approx(expected[k], rel=1e-12), k


def test_no_task_gathers_more_than_the_bound(spark, skewed, monkeypatch):
    df, _ = skewed
    seen = []
    real = quantiles._picked

    def watched(rows, state, keys, probs):
        b = F.explode("_b").alias("b")
        seen.append(state.select(b).where("b.inside > 50").collect())
        return real(rows, state, keys, probs)

    monkeypatch.setattr(quantiles, "_picked", watched)
    exact_quantiles(df, ["k"], "v", PROBS, gather=50).collect()
    # A bracket may hold more only where the rank lies on one of its ends: nothing of it is gathered.
    for row in seen[0]:
        b = row.b
        assert b.settled and (b.at_lo > 0 or b.at_hi > 0)


def test_without_keys_and_with_infinities(spark):
    values = [float("-inf")] * 3 + [float(i) for i in range(200)] + [float("inf")] * 5
    df = spark.createDataFrame([(x,) for x in values], "v double")
    for gather in (1000, 10):
        (row,) = exact_quantiles(df, [], "v", [0.0, 0.3, 0.5, 1.0], gather=gather).collect()
        assert row.n == 208 and row.q[0] == float("-inf") and row.q[3] == float("inf")
        assert list(row.q[1:3]) == pytest.approx(list(np.quantile(values, [0.3, 0.5])))
    assert exact_quantiles(df.limit(0), [], "v", [0.5]).collect() == []
    assert [r.q for r in attach_quantiles(df.limit(2), [], "v", [0.5], "q").collect()] == [[float("-inf")]] * 2


def test_attach_keeps_rows_of_null_keys(spark, skewed):
    df, expected = skewed
    got = attach_quantiles(df, ["k"], "v", PROBS, "q")
    assert got.count() == df.count()
    row = got.where("k is null").first()
    assert list(row.q) == pytest.approx(expected[None], rel=1e-12)
    assert got.where("k = 'none' and q is null").count() == 2
