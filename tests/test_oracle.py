"""Every query of the library against its SQL."""

import pytest

from slotline.plans.queries import QUERIES
from slotline.plans.sql import SQL
from tests.conftest import TESTDATA
from tests.oracle import check, connect

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check(spark, con, SF, QUERIES[name], SQL[name]) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
