"""Every engine query beside its SQL over the smallest tables."""

import os

import pytest

from tests.compare import connect, difference
from vertexloom.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tables, name):
    assert not difference(QUERIES[name](spark, SF), tables, ORACLES[name])
