"""The forecast run knows no period later than the one it forecasts from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import features as X
from panelwise.operators import stacking as S
from panelwise.plans import forecast as Q
from panelwise.session import settle

COLUMNS = ["K1", "K2"]


def panel(spark, changed_from=None):
    """Twenty entities, eight periods, gaps; values from ``changed_from`` on are others."""
    rng = np.random.default_rng(6)
    rows = []
    for e in range(20):
        for p in range(8):
            a, b = (float(v) for v in rng.uniform(0, 1, 2))
            if changed_from is not None and p >= changed_from:
                a, b = a * 7 + 3, b - 9
            rows.append((e, p, None if (e + p) % 6 == 0 else a, None if (e * p) % 7 == 3 else b))
    return settle(X.dense(spark.createDataFrame(rows, "entity int, period int, K1 double, K2 double"), COLUMNS))


def values(df, keys, names):
    return {tuple(r[k] for k in keys): [r[n] for n in names] for r in df.collect()}


def test_features_and_folds_before_a_change_stay(spark):
    one, two = panel(spark), panel(spark, 6)
    f1, names = Q.feature_stage(one, COLUMNS)
    f2, _ = Q.feature_stage(two, COLUMNS)
    early = F.col("period") < 6
    a, b = (values(f.where(early), ["entity", "period"], names) for f in (f1, f2))
    assert a == {k: pytest.approx(v, abs=1e-12) for k, v in b.items()} and None not in [x for v in a.values() for x in v]
    runs = [Q.run(g, COLUMNS, models=("bayesian_ridge", "fourier_ridge"), max_folds=9, mode="fit_only").out_of_fold for g in (one, two)]
    for got in zip(*[sorted(values(r.where(early), ["component", "model", "entity", "period"], ["yhat"]).items()) for r in runs], strict=True):
        assert got[0][0] == got[1][0] and got[0][1] == pytest.approx(got[1][1], abs=1e-9)
    past = [S.ensemble(r, settle(S.ridge_weights_so_far(r, ["bayesian_ridge", "fourier_ridge"]))) for r in runs]
    a, b = (values(p.where(early), ["component", "entity", "period"], ["yhat"]) for p in past)
    assert len(a) > 40 and a == {k: pytest.approx(v, abs=1e-9) for k, v in b.items()}


def test_gaps_get_the_mean_so_far(spark):
    grid = panel(spark)
    rows = grid.select("entity", "period", "K1").collect()
    filled, _ = Q.feature_stage(grid, COLUMNS)
    for r in filled.select("entity", "period", "f_K1").collect():
        own = next(x["K1"] for x in rows if (x["entity"], x["period"]) == (r["entity"], r["period"]))
        mean = np.mean([x["K1"] for x in rows if x["K1"] is not None and x["period"] <= r["period"]])
        assert r["f_K1"] == pytest.approx(mean if own is None else own)


def test_weights_of_a_period_are_those_of_the_periods_before(spark):
    rows = [(e, p, "K", m, float(e + p), e + p + (0.01 * e if m == "good" else 3.0 - e)) for e in range(9) for p in range(3) for m in ("good", "bad")]
    df = spark.createDataFrame(rows, "entity int, period int, component string, model string, y double, yhat double")
    got = values(S.ridge_weights_so_far(df, ["good", "bad"]), ["period", "model"], ["weight"])
    assert got[0, "good"] == got[0, "bad"] == [0.5]
    for p in (1, 2):
        want = values(S.ridge_weights(df.where(F.col("period") < p), ["good", "bad"]), ["model"], ["weight"])
        assert all(got[p, m] == pytest.approx(want[(m,)]) for m in ("good", "bad"))
