"""The queries of the subpackage that have SQL give the same rows as that SQL."""

import pytest

from tests.oracle import check
from vitrine.llm import catalogue

CASES = {name: (module.QUERIES[name], sql) for module in catalogue.MODULES for name, sql in module.SQL.items()}


@pytest.mark.parametrize("name", sorted(CASES))
def test_query_equals_its_sql(spark, name):
    check(spark, *CASES[name])


def test_found_queries_have_the_given_columns():
    names = {name for module in catalogue.MODULES for name in module.QUERIES}
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 8, 10)} <= names
    assert all(any(name.startswith(f"p{n}_") for name in names) for n in range(1, 11))
