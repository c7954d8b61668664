"""Replicate sums kept inside tasks against a copy of every row for each replicate."""

import pytest
from pyspark.sql import functions as F

from panelwise.operators import evaluate as E


@pytest.mark.parametrize("group", [["model"], ["model", "component"], []])
def test_bootstrap_equals_copied_rows(spark, group):
    """A null group, a group of one row, rows without truth and more rows than a piece holds."""
    rows = [("a", None if e % 5 == 0 else "k", e, float(e % 7), None if e % 11 == 3 else float(e % 13)) for e in range(2500)]
    df = spark.createDataFrame([*rows, ("b", "k", 1, 1.0, 3.0)], "model string, component string, entity int, y double, yhat double")
    got = E.bootstrap(df, group, ["entity"], 5, resamples=40).collect()
    copied = E.bootstrap(df, group, ["entity"], 5, lambda w, y, p: F.sum(w * F.abs(y - p)) / F.sum(w), resamples=40).collect()
    want = {tuple(r[g] for g in group): r for r in copied}
    assert len(got) == len(want)
    for r in got:
        other = want[tuple(r[g] for g in group)]
        assert [r[n] for n in ("mean", "low", "high")] == pytest.approx([other[n] for n in ("mean", "low", "high")])
