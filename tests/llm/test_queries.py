"""The registered queries with SQL, against it, and the names that the driver looks for."""

import pytest

from slotline.llm.queries import QUERIES, SQL
from tests.conftest import TESTDATA
from tests.oracle import check, connect

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    assert check(spark, con, SF, QUERIES[name], SQL[name]) > 0
