"""Every registered query against its SQL on the smallest tables."""

import pytest

from bookloom.plans.queries import QUERIES
from bookloom.plans.sql import ORACLE
from compare import differences

SF = "/root/testdata/sf0.001"
#: What SQL can't express; see test_operators.
FREE = {"epub_build", "page_items", "lcs_titles", "title_misses"}


def test_all_but_few_queries_have_sql():
    assert set(QUERIES) - set(ORACLE) == FREE and not set(ORACLE) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert not differences(QUERIES[name](spark, SF), ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(FREE))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
