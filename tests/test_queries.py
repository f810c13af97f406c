"""Every registered query against its SQL statement on the smallest tables."""

import pytest

import compare
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, name):
    rel = compare.duck(SF).sql(oracle_sql()[name])
    assert compare.difference(queries()[name](spark, SF), rel) is None


@pytest.mark.parametrize("name", ["clusters"])
def test_rows_only(spark, name):
    assert queries()[name](spark, SF).count() > 0
