import os

import pytest

from catalog import QUERIES, models
from catalog.forecast import CRITERIA
from panelwise.operators import models as M
from panelwise.plans import forecast as Q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_fits_and_grid_cover_every_component(spark):
    fits = QUERIES["fit_bayesian_ridge"](spark, FOLDER)
    assert {r["component"] for r in fits.select("component").distinct().collect()} == set(CRITERIA)
    assert fits.filter("yhat IS NULL").count() == 0


def test_forecast_run_uses_all_models_and_folds(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(Q, "run", lambda grid, columns, **options: seen.update(options))
    models.forecast_run(spark, FOLDER)
    assert set(seen["models"]) == set(M.MODELS) and seen["max_folds"] > 100


def test_fits_take_their_default_size(monkeypatch):
    seen = []
    monkeypatch.setattr(models, "fitted", lambda fit, spark, folder, **options: seen.append((fit, options)))
    models.fit_boosted_trees(None, FOLDER)
    assert seen == [(M.boosted_trees, {})]
    monkeypatch.setattr(models, "forecasts", lambda spark, folder: None)
    monkeypatch.setattr(models.S, "log_score_weights", lambda rows, names, **options: options)
    assert models.stack_log_score(None, FOLDER) == {}
