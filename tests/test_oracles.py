"""Every registered query runs; those with SQL agree with DuckDB row for row."""

import pytest

import __spark_entry__ as entry
from tools.check_oracles import compare, connect

NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, sf_dir, name):
    status, rows, _, notes = compare(spark, connection, name, sf_dir)
    assert status in ("match", "rows-only"), notes
    assert rows > 0


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(NAMES)
