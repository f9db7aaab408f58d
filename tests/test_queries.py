"""Every query with SQL gives what its SQL gives; the others run and keep their schema."""

import os

import compare
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
if not os.path.isdir(DATA):
    pytest.skip("test tables are not here", allow_module_level=True)
CORE = {n for m in entry._modules() if not m.__name__.startswith("rollbook.llm") for n in m.QUERIES}


@pytest.fixture(scope="module")
def con():
    return compare.views(DATA)


@pytest.mark.parametrize("name", sorted(CORE & set(entry.oracle_sql())))
def test_sql(spark, con, name):
    assert compare.differences(entry.queries()[name](spark, DATA), entry.oracle_sql()[name], con) == []


@pytest.mark.parametrize("name", sorted(CORE - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    assert entry.entry(spark).count() > 0
