"""Every registered query with an oracle gives the rows that DuckDB gives on the same tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) == []


def test_entry(spark):
    report = entry.entry(spark)
    assert set(report.columns) == {"model", "temperature", "label_group", "metric", "value", "std"}
    assert report.count() == 3 * 3 * 9   # three runs, three label groups, nine metrics


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
