"""Every query of the library on tables without rows."""


import pytest

from slotline.plans.queries import QUERIES
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"
ONE = {"truncate_log": 1, "status_options": 1, "slot_options": 0}  # rows that a query has all the same


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for name in ("events", "orders", "part", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, empty, name):
    df = QUERIES[name](spark, empty)
    assert df.count() == ONE.get(name, 0) and df.columns
