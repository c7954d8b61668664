"""Leaf distributions and adaptive widths for targets of any size, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.functions.relative_cells import ERROR, cell_of, upper_end
from panelwise.operators import adaptive as A
from panelwise.operators import models as M
from panelwise.session import settle


@pytest.fixture(scope="module")
def far(spark):
    """Targets near 1e9 that differ by units, a value held by a third of the rows, and one outlier."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        a, b = rng.uniform(-1, 1, 2)
        y = 1e9 if i % 3 == 0 else 1e9 + round(5 * a - 2 * b + rng.normal(), 3)
        rows.append((i, float(a), float(b), 1e15 if i == 1 else float(y)))
    return settle(spark.createDataFrame(rows, "id int, a double, b double, y double"))


def plain_leaves(forest, df):
    """For every row the leaves it falls into, and the targets of each leaf."""
    rows = M._leaves(forest.model, df, ["a", "b"], ["id", "y"]).collect()
    leaves, mine = {}, {}
    for r in rows:
        leaves.setdefault((r["tree"], r["leaf"]), []).append(r["y"])
        mine.setdefault(r["id"], []).append((r["tree"], r["leaf"]))
    return leaves, mine


@pytest.mark.parametrize("limit", [None, 40])
def test_forest_keeps_all_values_while_they_are_few(far, limit):
    forest = M.quantile_forest(far, ["a", "b"], "y", ["id"], trees=5, depth=4, cells=1000, limit=limit)
    leaves, mine = plain_leaves(forest, far)
    levels = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    for r in forest.quantiles(far, ["id"], levels).collect():
        pairs = sorted((y, 1 / len(leaves[p])) for p in mine[r["id"]] for y in leaves[p])
        upto = np.cumsum([w for _, w in pairs])
        for name, q in levels.items():
            assert r[name] == pairs[int(np.searchsorted(upto, q * 5 - 1e-9))][0]
        assert r["mean"] == pytest.approx(sum(y * w for y, w in pairs) / 5)


def test_forest_cells_keep_ranks_within_the_stated_share(far):
    cells = 10
    forest = M.quantile_forest(far, ["a", "b"], "y", ["id"], trees=5, depth=2, cells=cells)
    assert forest.leaves.agg(F.max(F.size("cells"))).first()[0] <= 2 * cells
    leaves, mine = plain_leaves(forest, far)
    for r in forest.quantiles(far, ["id"], {"q": 0.7}).collect():
        below = np.mean([np.mean(np.array(leaves[p]) < r["q"]) for p in mine[r["id"]]])
        upto = np.mean([np.mean(np.array(leaves[p]) <= r["q"]) for p in mine[r["id"]]])
        assert below - 2 / cells <= 0.7 <= upto + 2 / cells


def test_cells_hold_any_size(spark):
    values = [0.0, 5e-324, 1e-300, 0.001, 1.0, 1.001, 7e8, 1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", cell_of(F.col("x")).alias("cell"), upper_end(cell_of(F.col("x"))).alias("end")).collect()
    assert [r["cell"] for r in got] == sorted(r["cell"] for r in got)
    assert got[0]["end"] == 0
    for r in got[2:]:
        assert r["x"] * (1 - 1e-8) <= r["end"] <= r["x"] * (1 + ERROR) * (1 + 1e-8)


def plain_widths(periods, alpha, gamma):
    seen, a, out = [], alpha, []
    for rows in periods:
        if seen:
            width = sorted(seen)[int(min(math.ceil(round((1 - a) * (len(seen) + 1), 9)), len(seen))) - 1]
            miss = sum(r > width for r in rows) / len(rows)
            out.append((a, width, miss))
            a = min(max(a + gamma * (alpha - miss), 0.001), 0.999)
        seen += rows
    return out


@pytest.mark.parametrize("scale", [1e-9, 1.0, 1e6])
def test_adaptive_widths_at_any_scale(spark, scale):
    rng = np.random.default_rng(3)
    raw = [[float(abs(v)) * scale for v in rng.normal(0, 1 + p % 3, 40)] for p in range(6)]
    raw[2][0], raw[3][1] = 1e12 * scale, 0.0
    df = spark.createDataFrame([("g", p, 0.0, r) for p, rows in enumerate(raw) for r in rows], "g string, period int, y double, yhat double")
    step = math.log1p(ERROR)
    ends = [[math.exp(math.ceil(round(math.log(r) / step, 6)) * step) if r else 0.0 for r in rows] for rows in raw]
    got = A.adaptive_widths(df, ["g"], 0.2, 0.1).orderBy("period").collect()
    assert len(got) == 5
    for r, (a, width, miss) in zip(got, plain_widths(ends, 0.2, 0.1), strict=True):
        assert (r["alpha_t"], r["half_width"], r["miss"]) == (pytest.approx(a), pytest.approx(width, rel=1e-9, abs=0), pytest.approx(miss))
