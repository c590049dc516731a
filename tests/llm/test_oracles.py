"""Every registered query of the corpus operators against its SQL on the smallest tables."""

import pytest
from compare import differences

from bookloom.llm.queries import QUERIES
from bookloom.llm.sql import ORACLE

SF = "/root/testdata/sf0.001"


def test_what_sql_can_express():
    assert set(QUERIES) - set(ORACLE) == {"op2_html_extract", "op3_language_id", "op5_quality_classifier", "op8_substring_dedup"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert not differences(QUERIES[name](spark, SF), ORACLE[name], SF)
