import math

import pytest

from catalog import missing as catalog
from panelwise.operators import missing as J

COLUMNS = ["x", "y", "z"]
FOLDER = "/root/testdata/sf0.001"


def panel(spark):
    cells = lambda i, p: (i, p, float(i + p), None if i % 4 == 1 else 2.0 * i - p, None if i % 3 == 2 else 0.5 * i + 3.0 * p + i * p % 5)
    return spark.createDataFrame([cells(i, p) for i in range(14) for p in range(4)], "entity int, period int, x double, y double, z double")


def test_last_change_shows_that_the_rounds_ran_out(spark):
    df = panel(spark)
    last = lambda out: out.agg({"last_change": "max"}).first()[0]
    assert last(J.chained_equations(df, COLUMNS, 1, change_as="last_change")) > 1e-4


@pytest.mark.parametrize("name", ["chained_imputation", "panel_imputation", "low_rank_imputation", "pooled_imputations"])
def test_queries_come_to_rest(spark, name):
    rows = getattr(catalog, name)(spark, FOLDER).collect()
    assert rows and all(0 <= r["last_change"] < 1e-4 for r in rows)
    assert all(r["value"] is not None and math.isfinite(r["value"]) for r in rows if "value" in r)
