"""A cross-section of the registered queries against their SQL on the smallest tables.

``python tests/check_all.py`` runs all of them."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "complete_cases", "availability_report", "future_context", "scale_ranking", "two_level_weights_by_period",
    "vikor_compromise", "promethee_vshape", "rank_suppliers", "weight_stability_summary", "features_cross_entity",
    "training_pairs", "metric_summary", "interval_quality", "mcar_statistic", "interpolate_in_time", "membership_stability",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not here")


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    assert differences(entry.queries()[name](spark, FOLDER), duck(FOLDER), entry.oracle_sql()[name]) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"period", "entity", "composite", "n_criteria", "rank"}


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
