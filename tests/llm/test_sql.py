"""Queries that SQL can express against their SQL, on the small tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare, duck  # noqa: E402

from plumbline.llm.queries import QUERIES, SQL  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    problem, _, _ = compare(spark, duck(SMALL), name, QUERIES[name], SQL[name], SMALL)
    assert problem == "", problem
