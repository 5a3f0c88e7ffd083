import pytest

from trialspark.operators.correlated_looks import boundaries, correlated_boundaries

# Published two-sided boundaries of spending functions, alpha 0.05 spent by halves on each side, five equal looks.
PUBLISHED = {
    "obrien_fleming": [4.8769, 3.3569, 2.6803, 2.2898, 2.0310],
    "pocock": [2.4380, 2.4268, 2.4101, 2.3966, 2.3859],
}


@pytest.mark.parametrize("spending", sorted(PUBLISHED))
def test_published_constants(spending):
    assert boundaries(5, 0.05, spending, each_side=True) == pytest.approx(PUBLISHED[spending], abs=1e-3)


def test_one_look_is_a_fixed_test():
    assert boundaries(1) == pytest.approx([1.959964], abs=1e-5)
    # The first look has no earlier one to depend on: the plain boundary of the error it spends.
    assert boundaries(5)[0] == pytest.approx(1.959964 / 0.2**0.5, abs=1e-4)
    with pytest.raises(ValueError):
        boundaries(3, spending="other")


def test_joined_to_looks(spark):
    df = spark.createDataFrame([(1, 1), (2, 5), (5, 5), (5, 5), (6, 5), (None, 5), (1, None)], "k int, n int")
    got = [(r.k, r.n, r.z_correlated) for r in correlated_boundaries(df, "k", "n").collect()]
    z = boundaries(5)
    want = {(1, 1): boundaries(1)[0], (2, 5): z[1], (5, 5): z[4]}
    assert len(got) == 7 and all(x == (pytest.approx(want[k, n]) if (k, n) in want else None) for k, n, x in got)
    assert correlated_boundaries(df.limit(0), "k", "n").count() == 0
