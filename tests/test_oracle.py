"""Every registered query against its cross-check SQL."""

import oracle
import pytest

import __spark_entry__ as entry
from textrules.catalog import entries

SF = "/root/testdata/sf0.001"
OWN = entries()
CHECKS = {name: check for name, (_, check) in OWN.items() if check is not None}
# Results that depend on floating-point training have property tests instead.
WITHOUT_SQL = {"lda_fit", "lda_assign"}


@pytest.fixture(scope="module")
def duck():
    return oracle.duck(SF)


def test_all_queries_have_a_check():
    assert set(OWN) <= set(entry.queries())
    assert set(OWN) - set(CHECKS) == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, duck, name):
    problems = oracle.compare(entry.queries()[name](spark, SF), duck, CHECKS[name])
    assert not problems


def test_entry(spark):
    assert entry.entry(spark).count() > 0
