"""Every engine query with SQL gives the same rows as that SQL."""

import pytest

from tests.oracle import check
from vitrine.plans import catalogue

CASES = {name: (module.QUERIES[name], sql) for module in catalogue.MODULES for name, sql in module.SQL.items()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_query_equals_its_sql(spark, name):
    check(spark, *CASES[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    out = entry.entry(spark)
    assert out.columns == ["query_id", "product_id", "sparse_rank", "dense_rank", "source_count", "rrf", "rank"]
    assert out.count() > 0


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
