"""Every query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from keepsake.plans import catalog
from tools.check_oracle import compare

SF = "/root/testdata/sf0.001"
NAMES = sorted(catalog.all_queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, name).startswith("ok")


def test_every_query_has_sql():
    assert NAMES == sorted(catalog.all_sql())
    assert set(NAMES) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "status" in df.columns and df.count() > 0
