"""Bucketed ranks, sums and quantiles equal the plain ones, under skew and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value a third of them."""
    rng = np.random.default_rng(3)
    rows = [(1, float(v)) for v in rng.normal(size=300).round(2)] + [(1, 0.5)] * 150 + [(2, float(i)) for i in range(5)] + [(3, None)]
    return spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id int, g int, v double")


@pytest.mark.parametrize("method", ["min", "truncated", "average"])
@pytest.mark.parametrize("descending", [True, False])
def test_ranks(skewed, method, descending):
    spec = {"r": ("v", descending, method)}
    plain = {r["id"]: r["r"] for r in O.add_ranks(skewed, ["g"], spec).collect()}
    split = {r["id"]: r["r"] for r in O.add_ranks(skewed, ["g"], spec, limit=20).collect()}
    assert plain == split
    pdf = skewed.toPandas()
    want = pdf.groupby("g")["v"].rank(ascending=not descending, method="min" if method == "min" else "average")
    for i, w in zip(pdf["id"], want):
        assert plain[i] is None if np.isnan(w) else plain[i] == (int(w) if method != "average" else w)


def test_quantiles(skewed):
    levels = {"q10": 0.1, "q50": 0.5, "q95": 0.95}
    a = {r["g"]: r for r in O.group_quantiles(skewed, ["g"], "v", levels).collect()}
    b = {r["g"]: r for r in O.group_quantiles(skewed, ["g"], "v", levels, limit=15).collect()}
    for g, part in skewed.toPandas().dropna().groupby("g"):
        for n, q in levels.items():
            assert a[g][n] == pytest.approx(np.quantile(part["v"], q)) == pytest.approx(b[g][n])


def test_running_sums(skewed):
    counts = O.value_counts(skewed, ["g"], "v")
    a = {(r["g"], r["v"]): r["c"] for r in O.running_sums(counts, ["g"], "v", {"c": F.col("_n")}).collect()}
    b = {(r["g"], r["v"]): r["c"] for r in O.running_sums(counts, ["g"], "v", {"c": F.col("_n")}, limit=10).collect()}
    assert a == b


def test_spearman(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, 80).astype(float)
    y = x + rng.normal(0, 2, 80).round(0)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, b double")
    import pandas as pd

    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert O.spearman(df, [], "a", "b").first()["rho"] == pytest.approx(want)
    assert O.spearman(df, [], "a", "b", limit=10).first()["rho"] == pytest.approx(want)
    assert O.spearman(df.withColumn("b", F.lit(1.0)), [], "a", "b").first()["rho"] is None


def test_partitions_do_not_matter(skewed):
    one = O.add_ranks(skewed.repartition(1), ["g"], {"r": ("v", True, "truncated")}).orderBy("id").collect()
    many = O.add_ranks(skewed.repartition(7), ["g"], {"r": ("v", True, "truncated")}).orderBy("id").collect()
    assert one == many
