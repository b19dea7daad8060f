"""Every registered query against its SQL on the smallest given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, sf_dir, name):
    line = compare(spark, con, name, queries()[name], oracle_sql().get(name), sf_dir)
    assert not line.startswith("FAIL"), line
    assert "types" not in line, line


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0 and "syscall_entropy" in df.columns


def test_checks_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())
