"""Every training-data query that has SQL, against it."""

import pytest
from parity import connect, differences

from trialspark.llm.queries import ORACLE, QUERIES
from trialspark.session import tune


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    assert differences(QUERIES[name](tune(spark), sf), con, ORACLE[name]) is None
