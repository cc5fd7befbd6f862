"""Every registered query against its SQL on the driver's tables; every query without SQL runs."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import connect, differences  # noqa: E402

from terralith import catalog  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.ORACLES:
        assert differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF, con) == ""
    else:
        assert catalog.QUERIES[name](spark, SF).limit(5).collect() is not None
