"""Distribution columns against the JVM's math library."""

import math

import pytest
from pyspark.sql import functions as F

from trialspark.functions import distributions as d

C = F.col


@pytest.fixture(scope="module")
def jvm(spark):
    return spark._jvm.org.apache.commons.math3.distribution


def test_normal_tail_matches_erfc(spark):
    zs = [-38.0, -9.0, -7.2, -3.0, -1.0, 0.0, 0.3, 2.0, 6.9, 8.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", d.norm_sf(C("z")).alias("p"))
    for r in rows.collect():
        assert r.p == pytest.approx(0.5 * math.erfc(r.z / math.sqrt(2)), rel=1e-7, abs=1e-300)


def test_normal_quantile_inverts(spark):
    ps = [1e-9, 1e-5, 0.01, 0.024, 0.3, 0.5, 0.8, 0.975, 0.99999]
    rows = spark.createDataFrame([(p,) for p in ps], "p double").select("p", d.norm_ppf(C("p")).alias("z"))
    for r in rows.collect():
        assert r.z == pytest.approx(d.z_value(r.p), abs=1e-8)


def test_t_tail_and_quantile(spark, jvm):
    cases = [(df, t) for df in (1.0, 1.3, 2.0, 3.7, 10.0, 58.3, 1498.0) for t in (0.0, 0.5, 1.96, 4.0)]
    frame = spark.createDataFrame(cases, "df double, t double")
    out = frame.select(
        "df", "t", d.t_sf(C("t"), C("df")).alias("p"), d.t_quantile(0.975, C("df")).alias("q")
    ).collect()
    for r in out:
        t = jvm.TDistribution(r.df)
        assert r.p == pytest.approx(t.cumulativeProbability(-r.t), rel=1e-9)
        assert t.cumulativeProbability(-r.q) == pytest.approx(0.025, rel=1e-9)


def test_chi_square_tail(spark, jvm):
    cases = [(k, x) for k in range(1, 12) for x in (0.0, 0.1, 1.0, 5.0, 20.0, 60.0)]
    rows = spark.createDataFrame(cases, "k int, x double").select("k", "x", d.chi2_sf(C("x"), C("k")).alias("p"))
    for r in rows.collect():
        want = 1 - jvm.ChiSquaredDistribution(float(r.k)).cumulativeProbability(r.x)
        assert r.p == pytest.approx(want, abs=1e-12)


def test_chi_square_without_freedom_is_null(spark):
    row = spark.createDataFrame([(0, 3.0)], "k int, x double").select(d.chi2_sf(C("x"), C("k")).alias("p")).first()
    assert row.p is None
