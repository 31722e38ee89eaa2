"""Registered queries against their SQL at the smallest scale (PLUMBLINE_ALL=1 runs every one)."""

import os

import pytest

from oracle import compare, duck
from plumbline.plans import QUERIES, SQL, load_all

from conftest import SMALL

load_all()
SAMPLE = """cal1 cal4_robust cal5_preset cal6 dec1 dec2 dec3 agg3 agg4 agg5 agg8 agg9 jn1 jn2 win1 src1_ src5 src6 src9 src16
flt2 flt9 txt9 txt10 geo1 geo4 jn6 win4 win5 win15 sco1_ sco6 sco16 reg2 txt5 txt8 win13 rag3 udf1 udf6 str3 str4""".split()
NAMES = [n for n in QUERIES if os.environ.get("PLUMBLINE_ALL") or any(n.startswith(s) for s in SAMPLE)]


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    problem, _, _ = compare(spark, con, name, QUERIES[name], SQL.get(name), SMALL)
    assert problem == "", problem


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) > 160


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
