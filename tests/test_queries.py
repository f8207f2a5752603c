"""Every registered query against its SQL, on the smallest supplied tables."""

import os

import pytest

from workload.compare import connect, differences
from workload.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def connection():
    pytest.importorskip("duckdb")
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    assert differences(spark, connection, FOLDER, name) is None
