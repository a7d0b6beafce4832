import os
import sys

import pytest
from oracle_check import compare, views

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, queries()[name], oracle_sql().get(name)) is None


def test_entry_and_registry(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).columns == ["location", "site", "quantity", "price", "discount", "tax"]
