"""Every registered query of the market library against its SQL; those without are tested by brute force."""

import pytest
from compare import DATA, assert_same

from tidemark import plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert_same(plans.queries()[name](spark, DATA), duck, SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:3] == ["agent_id", "symbol", "date"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
