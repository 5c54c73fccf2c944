import pytest

from rowloom.plans import catalogue, wider  # noqa: F401 (wider registers its queries)
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, folder, name):
    assert differences(catalogue.QUERIES[name](spark, folder), folder, catalogue.ORACLE_SQL[name]) == []


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE_SQL.keys()))
def test_runs(spark, folder, name):
    assert catalogue.QUERIES[name](spark, folder).count() > 0
