"""Every registered query runs; those with oracle SQL must match it."""

import re

import __spark_entry__ as entry
import pytest
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


# Text queries have tests of their own.
OWN_TESTS = re.compile(r"ml_|op\d+_|pipeline$")


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_matches_oracle(spark, connection, name):
    assert compare(spark, connection, SF, name).startswith("ok")


def test_only_models_and_text_lack_an_oracle():
    missing = set(entry.queries()) - set(entry.oracle_sql())
    assert all(OWN_TESTS.match(n) for n in missing)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 95 and df.count() > 0
