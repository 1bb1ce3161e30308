import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as entry_mod  # noqa: E402
from oracle_check import compare, open_duckdb  # noqa: E402
from pulsegrid.plans.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return open_duckdb(SF)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["subject_id", "date", "metric", "value", "rolling_mean", "rolling_std",
                          "expected_low", "expected_high", "deviation_sigma", "severity"]
    assert df.count() >= 0


def test_every_analysis_query_has_an_oracle():
    assert set(QUERIES) <= set(entry_mod.queries())
    assert set(QUERIES) <= set(entry_mod.oracle_sql()) <= set(entry_mod.queries())


@pytest.mark.parametrize("name", sorted(entry_mod.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = entry_mod.queries()[name](spark, SF).toPandas()
    odf = duck.execute(entry_mod.oracle_sql()[name]).to_arrow_table().to_pandas()
    assert compare(sdf, odf) is None
