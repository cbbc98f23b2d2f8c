"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import compare
import pytest

from sitescope.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.SQL:
        assert compare.differences(spark, con, catalog.QUERIES[name], catalog.SQL[name], SF) == ""
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["building_id", "eligible", "score", "failed", "missing"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
