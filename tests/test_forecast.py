"""Metrics, splits, intervals, models, stacking and the streaming updates."""

from threading import Barrier

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import adaptive as A
from panelwise.operators import evaluate as E
from panelwise.operators import features as X
from panelwise.operators import intervals as I
from panelwise.operators import models as M
from panelwise.operators import reduce as L
from panelwise.operators import splits as S
from panelwise.operators import stacking as T
from panelwise.plans import forecast as Q
from panelwise.session import settle
from panelwise.streaming import updates as U


@pytest.fixture(scope="module")
def made(spark):
    """y = 1 + 2a - b + noise, eight periods."""
    rng = np.random.default_rng(4)
    rows = []
    for e in range(40):
        for p in range(8):
            a, b, c = rng.uniform(-1, 1, 3)
            rows.append((e, p, float(a), float(b), float(c), float(1 + 2 * a - b + rng.normal(0, 0.1))))
    return settle(spark.createDataFrame(rows, "entity int, period int, a double, b double, c double, y double"))


@pytest.fixture(scope="module")
def forecasts(made):
    noisy = {"good": F.col("y") + 0.1 * F.sin(F.col("entity") * 7 + F.col("period")), "bad": F.col("y") * 0 + 1.0}
    cells = F.array(*[F.struct(F.lit(m).alias("model"), v.alias("yhat")) for m, v in noisy.items()])
    return settle(made.select("entity", "period", F.lit("k").alias("component"), "y", F.inline(cells)))


def test_metric_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "y double, yhat double")
    assert E.metric_summary(df).first()["r2"] == 1
    mean = E.metric_summary(df.withColumn("yhat", F.lit(2.0))).first()
    assert mean["r2"] == pytest.approx(0) and mean["correlation"] == 0 and mean["mae"] == pytest.approx(2 / 3)


def test_walk_forward_never_looks_ahead(made):
    tagged = S.walk_forward(made, min_train=3, max_folds=2)
    assert tagged.where("role = 'train' AND period >= val_period").count() == 0
    assert {(r["fold"], r["val_period"], r["n_train"], r["n_validate"]) for r in S.split_sizes(tagged).collect()} == {(0, 3, 120, 40), (1, 4, 160, 40)}
    assert S.fold_table(made, min_train=50).first()["val_period"] == 7


@pytest.mark.parametrize("name", sorted(M.MODELS))
def test_models_beat_the_mean(made, name):
    fit = M.MODELS[name](made.where("period < 6"), ["a", "b", "c"], "y")
    rows = fit.predict(made.where("period >= 6")).select("y", "yhat")
    assert E.metric_summary(rows).first()["r2"] > 0.5
    if fit.importance:
        assert fit.importance["a"] > fit.importance["c"]


def test_quantile_forest_is_monotone(made):
    forest = M.quantile_forest(made, ["a", "b", "c"], "y", ["entity", "period"], trees=5)
    q = forest.quantiles(made, ["entity", "period"], {"low": 0.1, "mid": 0.5, "high": 0.9})
    assert q.where("low > mid OR mid > high").count() == 0 and q.count() == 320


def test_grid_search_prefers_the_small_penalty(made):
    fit, table = M.elastic_net_cv(made, ["a", "b", "c"], "y", penalties=(0.001, 5.0), l1_ratios=(0.5,), max_folds=2)
    assert table.orderBy(F.desc("r2")).first()["setting"] == 0


def test_stack_prefers_the_better_model(forecasts):
    for w in (T.ridge_weights(forecasts, ["good", "bad"]), T.log_score_weights(forecasts, ["good", "bad"], rounds=10)):
        got = {r["model"]: r["weight"] for r in w.collect()}
        assert got["good"] > 0.9 and got["good"] + got["bad"] == pytest.approx(1)
    spread = {r["model"]: r for r in T.weight_spread(forecasts, ["good", "bad"], 1, 20).collect()}
    assert spread["good"]["mean"] > 0.9 and spread["good"]["sd"] < 0.1
    old = forecasts.select("component", "model").distinct().withColumn("weight", F.lit(0.5))
    new = {r["model"]: r["weight"] for r in T.update_weights(forecasts, old, ["good", "bad"], gamma=0.3).collect()}
    assert 0.5 < new["good"] <= 0.8 + 1e-9


def test_conformal_widths(forecasts):
    w = {r["model"]: r for r in I.symmetric(forecasts, ["model"], 0.1).collect()}
    res = forecasts.where("model = 'good'").toPandas()
    r = np.abs((res["y"] - res["yhat"]).round(10))
    n = len(r)
    assert w["good"]["half_width"] == pytest.approx(np.quantile(r, min(np.ceil(0.9 * (n + 1)) / n, 1)))
    iv = I.predict(forecasts, I.symmetric(forecasts, ["model"], 0.1), ["model"])
    assert all(r["coverage"] >= 0.89 for r in I.coverage(iv, ["model"]).collect())


def test_adaptive_and_student_widths(forecasts):
    a = A.adaptive_widths(forecasts, ["model"]).collect()
    assert len(a) == 14 and all(0.001 <= r["alpha_t"] <= 0.999 for r in a)
    s = A.student_widths(forecasts, ["model", "period"]).collect()
    assert len(s) == 16 and all(r["half_width"] >= 0 for r in s)


def test_student_width_of_known_shape(spark):
    from panelwise.functions.special import t_quantile

    n = 90
    rows = [(1.0 * t_quantile(0.5 + 0.5 * (i + 0.5) / n, 6), 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, "y double, yhat double").withColumn("g", F.lit(1))
    got = A.student_widths(df, ["g"]).first()["half_width"]
    assert got == pytest.approx(t_quantile(0.9, 5), rel=0.15)


def test_reduction(made):
    twin = made.withColumn("d", F.col("a") * 2 + 0.001 * F.col("c"))
    assert L.keep_distinct(twin, ["a", "b", "c", "d"]) == ["a", "b", "c"]
    assert L.keep_varying(made.withColumn("f", F.lit(1.0)), ["a", "f"]) == ["a"]
    loadings, names = L.principal_components(made, ["a", "b", "c"], share=1.0)
    assert loadings.shape == (3, 3) and np.allclose(loadings.T @ loadings, np.eye(3))
    w = L.partial_least_squares(made, ["a", "b", "c"], ["y"], 1)
    assert abs(w[0, 0]) > abs(w[1, 0]) > abs(w[2, 0])
    mi = {r["feature"]: r["mi"] for r in L.mutual_information(made, ["a", "c"], ["y"], ["entity", "period"]).collect()}
    assert mi["a"] > mi["c"]
    assert L.effective_outputs(twin, ["a", "d"]) == 1


def test_shift_is_found(made):
    moved = made.withColumn("late", (F.col("period") >= 4).cast("int")).withColumn("a", F.col("a") + F.col("late"))
    row = T.shift_statistic(settle(moved), ["a", "b"], "late", permutations=20).first()
    assert row["shifted"] and row["mmd2"] > row["threshold"]
    w = T.importance_weights(moved, ["a", "b"], "late")
    assert w.agg(F.avg("importance_weight")).first()[0] == pytest.approx(1)


def test_bootstrap_interval_holds_the_metric(forecasts):
    row = E.bootstrap(forecasts.where("model = 'good'"), ["model"], ["entity", "period"], 3, resamples=100).first()
    mae = E.metric_summary(forecasts.where("model = 'good'")).first()["mae"]
    assert row["low"] < mae < row["high"]


def test_fits_of_a_run_are_under_way_together(made):
    """A fit that waits for another one ends only if both run at a time."""
    gate = Barrier(2, timeout=20)

    def waiting(df, x, y):
        gate.wait()
        return M.Fitted("waiting", lambda new: new.withColumn("yhat", F.lit(0.5)), {"a": 1.0})

    rows = made.withColumn("y_k", F.col("y"))
    out = T.out_of_fold(rows, {"one": waiting, "two": waiting}, ["a"], {"k": "y_k"}, ["entity", "period"], max_folds=2)
    assert {(r["fold"], r["model"], r["count"]) for r in out.groupBy("fold", "model").count().collect()} == {(f, m, 40) for f in (0, 1) for m in ("one", "two")}
    refitted, importance = Q.predict_stage(rows, ["a"], ["k"], {"one": waiting, "two": waiting})
    assert refitted.count() == 80 and importance == {"a": 1.0}


def test_forecast_run(spark):
    rows = [(e, p, float((e * 3 + p * 2) % 11) / 10 + e / 20, float(e) / 20) for e in range(20) for p in range(8)]
    df = spark.createDataFrame(rows, "entity int, period int, K1 double, K2 double")
    grid = settle(X.dense(df, ["K1", "K2"]))
    run = Q.run(grid, ["K1", "K2"], models=("bayesian_ridge",), max_folds=2)
    out = run.predictions.collect()
    assert len(out) == 40 and {r["period"] for r in out} == {8}
    assert all(r["lower"] <= r["yhat"] <= r["upper"] for r in out)
    assert Q.run(grid, ["K1"], mode="features_only").out_of_fold is None
    with pytest.raises(ValueError):
        Q.run(grid, ["K1"], mode="other")


def test_streaming_updates(spark, forecasts, tmp_path):
    src = str(tmp_path / "in")
    for p in (0, 1, 2):
        forecasts.where(F.col("period") == p).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(forecasts.schema).option("maxFilesPerTrigger", 1).parquet(src)
    U.update_weights_stream(stream, str(tmp_path / "w"), str(tmp_path / "cw"), ["good", "bad"]).awaitTermination()
    w = {r["model"]: r["weight"] for r in U.latest(spark, str(tmp_path / "w")).collect()}
    assert w["good"] > 0.7 and sum(w.values()) == pytest.approx(1)
    U.adaptive_widths_stream(stream, str(tmp_path / "a"), str(tmp_path / "ca"), ["model"]).awaitTermination()
    state = U.latest(spark, str(tmp_path / "a"))
    got = {r["model"]: r["half_width"] for r in U.widths(state, ["model"]).collect()}
    assert 0 < got["good"] <= 0.101 < got["bad"]
    assert state.groupBy("model").agg(F.sum("n").alias("n")).first()["n"] == 120
