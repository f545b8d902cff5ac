"""Every query of the core that has SQL gives the rows of its SQL; the others run and keep their columns."""

import os

import pytest

from kernwerk import catalogue
from tests.harness import compare

DATA = os.environ.get("KERNWERK_DATA", "/root/testdata/sf0.001")


class Entry:
    @staticmethod
    def queries():
        return catalogue.QUERIES

    @staticmethod
    def oracle_sql():
        return catalogue.ORACLE


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, name):
    got, want = compare(spark, name, DATA, Entry)
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES)


def test_entry_imports_without_the_optional_part():
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries())
