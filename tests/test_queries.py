"""Every registered query against its SQL, value by value."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from cartlens.catalog import CATALOG
from tests.compare import differences, duckdb_connection
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    return duckdb_connection(SMALL)


def test_every_report_has_sql():
    assert set(CATALOG) <= set(queries())
    assert set(CATALOG) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_equals_sql(spark, connection, name):
    assert differences(queries()[name](spark, SMALL), connection, oracle_sql()[name]) == []


def test_flagship_query(spark):
    rows = entry(spark).collect()
    assert {row.rfm_segment for row in rows} <= {"Champions", "Loyal", "Potential Loyalist", "At Risk", "Lost"}
    assert sum(row.customers for row in rows) > 0
