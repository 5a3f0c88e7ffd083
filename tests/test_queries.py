"""Every registered query against its own SQL."""

import pytest

from parity import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from trialspark.queries import ORACLE as CORE_ORACLE, QUERIES as CORE_QUERIES

QUERIES = {name: fn for name, fn in queries().items() if name in CORE_QUERIES}
ORACLE = {name: sql for name, sql in oracle_sql().items() if name in CORE_ORACLE}
# Credible intervals have no plain SQL form; tests hold them against exact sums and large samples.
DRAWS = {"beta_binomial_test", "normal_normal_test"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_only_draws_lack_sql():
    assert set(QUERIES) - set(ORACLE) == DRAWS
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(DRAWS))
def test_draw_queries_give_rows(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows and all(0 <= r.prob_treatment_better <= 1 for r in rows)


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "verdict" in df.columns
