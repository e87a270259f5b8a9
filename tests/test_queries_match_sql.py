"""Every retail query gives the rows that its SQL gives in another engine."""

import pytest
from compare import differences, duck

from basketforge.plans import all_queries, all_sql


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_same_rows(spark, con, small, name):
    assert differences(spark, con, all_queries()[name], all_sql()[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_rows_without_sql(spark, small, name):
    assert all_queries()[name](spark, small).count() > 0
