"""Every registered query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import pytest

from florascan import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(name, same):
    same(plans.QUERIES[name], plans.SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["experiment", "plant"]


def test_every_sql_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
