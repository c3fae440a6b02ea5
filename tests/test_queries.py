"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from siltstone.plans.catalog import CATALOG


@pytest.mark.parametrize("name", sorted(CATALOG.queries))
def test_query(name, spark, small, same_as_sql):
    df = CATALOG.queries[name](spark, small)
    if name in CATALOG.sql:
        same_as_sql(df, CATALOG.sql[name])
    else:
        df.collect()


def test_names_are_unique_and_lower_case():
    assert all(n == n.lower() for n in CATALOG.queries)
    assert set(CATALOG.sql) <= set(CATALOG.queries)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
