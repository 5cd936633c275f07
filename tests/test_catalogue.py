"""Every registered query against its SQL, and the driver's entry points."""

import pytest

import __spark_entry__ as driver
from bidlake.plans.catalogue import REGISTRY
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, duck, name):
    df = REGISTRY[name](spark, FOLDER)
    got = (df.columns, [tuple(r) for r in df.collect()])
    if REGISTRY[name].sql is None:
        assert got[1]
        return
    result = duck.execute(REGISTRY[name].sql)
    assert difference(got, ([d[0] for d in result.description], result.fetchall())) is None


def test_entry_points(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
