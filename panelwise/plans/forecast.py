"""Forecast of the next period, in stages over DataFrames.

features -> out-of-fold forecasts -> weights -> predictions -> intervals ->
evaluation. Every stage can be called alone; :func:`run` chains them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, Window, functions as F

from panelwise.functions.guards import all_of, lit, total
from panelwise.operators import evaluate as E
from panelwise.operators import features as X
from panelwise.operators import intervals as I
from panelwise.operators import stacking as S
from panelwise.operators.critic import critic_matrix
from panelwise.operators.missing import fill_with_means_so_far
from panelwise.operators.models import MODELS, Fitted, mean_importance
from panelwise.operators.passes import with_stats
from panelwise.panel import ENTITY, PERIOD, to_long
from panelwise.session import settle, together

KEYS = [ENTITY, PERIOD, "component"]
MODES = ("full", "features_only", "fit_only", "evaluate_only")


@dataclass
class ForecastRun:
    features: DataFrame
    names: list[str]
    out_of_fold: DataFrame | None = None
    weights: DataFrame | None = None
    predictions: DataFrame | None = None
    by_model: DataFrame | None = None
    widths: DataFrame | None = None
    metrics: DataFrame | None = None
    importance: dict[str, float] = field(default_factory=dict)


def feature_stage(grid: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """One row per (entity, period): filled features and the next period's values as targets.

    Every family is a set of windows over one entity's periods, so the whole table
    needs one shuffle. Gaps are filled with means over all entities up to the row's own period, so no row
    knows a later period, whichever fold it serves."""
    w = X.over_time()
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    last3 = w.rowsBetween(-2, 0)
    cells = {}
    for c in columns:
        cells[f"f_{c}"] = F.col(c)
        cells[f"f_{c}_lag1"] = F.lag(c, 1).over(w)
        cells[f"f_{c}_lag2"] = F.lag(c, 2).over(w)
        cells[f"f_{c}_mean3"] = F.when(F.col("position") >= 2, F.avg(c).over(last3))
        cells[f"f_{c}_expanding"] = F.avg(c).over(up)
        cells[f"f_{c}_momentum"] = F.col(c) - F.lag(c, 1).over(w)
        cells[f"y_{c}"] = F.lead(c).over(w)
    names = [n for n in cells if n.startswith("f_")]
    rows = settle(grid.withColumns(cells).select(ENTITY, PERIOD, *cells))
    level = {n: f"f_{c}" for c in columns for n in names if n.startswith(f"f_{c}_") and not n.endswith("_momentum")}
    return settle(fill_with_means_so_far(rows, names, level)), names


def fit_stage(
    features: DataFrame, names: Sequence[str], columns: Sequence[str], fits: Mapping[str, Callable[..., Fitted]],
    min_train: int = 3, max_folds: int = 3,
) -> DataFrame:
    """Walk-forward forecasts of every model and component; period is the TARGET's."""
    targets = {c: f"y_{c}" for c in columns}
    rows = S.out_of_fold(features, fits, names, targets, [ENTITY, PERIOD], min_train, max_folds)
    return settle(rows.withColumn(PERIOD, F.col(PERIOD) + 1))


def predict_stage(
    features: DataFrame, names: Sequence[str], columns: Sequence[str], fits: Mapping[str, Callable[..., Fitted]]
) -> tuple[DataFrame, dict[str, float]]:
    """Refit on all rows with a target; predict the period after the last one. Fits run several at a time."""
    last = features.agg(F.max(PERIOD)).first()[0]
    each = [(c, name) for c in columns for name in fits]
    refit = lambda c, name: fits[name](features.where(F.col(f"y_{c}").isNotNull()), names, f"y_{c}")
    fitted = together(features.sparkSession, [partial(refit, *of) for of in each])
    rows = [
        model.predict(features.where(F.col(PERIOD) == last)).select(
            ENTITY, (F.col(PERIOD) + 1).alias(PERIOD), F.lit(c).alias("component"),
            F.lit(None).cast("double").alias("y"), F.lit(name).alias("model"), "yhat",
        )
        for (c, name), model in zip(each, fitted, strict=True)
    ]
    return settle(reduce(DataFrame.unionByName, rows)), mean_importance([model.importance for model in fitted])


def run(
    grid: DataFrame,
    columns: Sequence[str],
    models: Sequence[str] = ("bayesian_ridge", "fourier_ridge"),
    alpha: float = 0.1,
    min_train: int = 3,
    max_folds: int = 3,
    mode: str = "full",
) -> ForecastRun:
    """``grid``: dense panel of components with ``position`` (see ``features.dense``)."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    features, names = feature_stage(grid, columns)
    out = ForecastRun(features, names)
    if mode == "features_only":
        return out
    fits = {m: MODELS[m] for m in models}
    out.out_of_fold = fit_stage(features, names, columns, fits, min_train, max_folds)
    out.weights = S.ridge_weights(out.out_of_fold, list(models))
    if mode == "fit_only":
        return out
    # each fold is combined with weights of the folds before it, so that its errors are those of a forecast
    earlier = settle(S.ridge_weights_so_far(out.out_of_fold, list(models)))
    past = settle(S.ensemble(out.out_of_fold, earlier).withColumn("model", F.lit("ensemble")))
    out.metrics = settle(E.metric_summary(out.out_of_fold, ["model", "component"]).unionByName(E.metric_summary(past, ["model", "component"])))
    if mode == "evaluate_only":
        return out
    out.by_model, out.importance = predict_stage(features, names, columns, fits)
    future = S.ensemble(out.by_model, out.weights)
    out.widths = settle(I.symmetric(past, ["component"], alpha))
    out.predictions = settle(I.predict(future, out.widths, ["component"]))
    return out


def prediction_matrix(predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per entity and period, a column per component."""
    return predictions.groupBy(ENTITY, PERIOD).agg(
        *[F.max(F.when(F.col("component") == c, F.col("yhat"))).alias(c) for c in columns]
    )


def critic_composite(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Weighted sum of predicted criteria, the weights by CRITIC of the predictions.

    Constant columns weigh 0; with fewer than two rows or no varying column, the
    plain mean. One row of weights, attached to every row."""
    rows = matrix.withColumn("_m", F.lit(0))
    stats = critic_matrix(rows, columns, ["_m"]).select("_m", *[f"weight_{c}" for c in columns], *[f"sd_{c}" for c in columns], f"_n_{columns[0]}")
    raw = {c: F.when(F.col(f"sd_{c}") > 1e-9, F.col(f"weight_{c}")).otherwise(lit(0)) for c in columns}
    whole = total(raw.values())
    usable = (whole > 0) & (F.col(f"_n_{columns[0]}") >= 2)
    share = {c: F.when(usable, F.try_divide(raw[c], whole)).otherwise(lit(1 / len(columns))) for c in columns}
    weights = settle(stats.select("_m", *[v.alias(f"w_{c}") for c, v in share.items()]))
    placed = rows.join(weights, "_m")
    return placed.select(
        ENTITY, PERIOD, *columns, total(F.col(c) * F.col(f"w_{c}") for c in columns).alias("composite")
    )


def with_history(panel_data: DataFrame, predicted: DataFrame) -> DataFrame:
    """Forecast rows under the history, so that both are ranked by the same run."""
    cols = panel_data.columns
    return panel_data.unionByName(predicted.select(*cols))


# ----------------------------------------------------------------- result tables


def importance_table(spark, importance: Mapping[str, float]) -> DataFrame:
    """``(feature, importance, cumulative, position)``; one row per feature of the schema."""
    rows = spark.createDataFrame(sorted(importance.items()), "feature string, importance double")
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), F.col("feature"))
    return rows.select(
        "feature", "importance", F.sum("importance").over(w).alias("cumulative"), F.row_number().over(w).alias("position")
    )


def model_comparison(metrics: DataFrame) -> DataFrame:
    """Mean metrics per model, rank by R2, best flag and a note."""
    mean = metrics.groupBy("model").agg(*[F.avg(m).alias(m) for m in ("r2", "rmse", "mae")])
    w = Window.partitionBy(F.lit(0)).orderBy(F.round("r2", 9).desc(), F.col("model"))
    rank = F.row_number().over(w)
    note = F.when(F.col("r2") < 0, F.lit("worse than the mean")).when(F.col("r2") < 0.5, F.lit("weak")).otherwise(F.lit("usable"))
    return mean.withColumns({"position": rank, "best": rank == 1, "note": note})


def rmse_by_component(metrics: DataFrame) -> DataFrame:
    return metrics.select("component", "model", "rmse")


def residual_table(out_of_fold: DataFrame) -> DataFrame:
    return E.known(out_of_fold).withColumn("residual", F.col("y") - F.col("yhat"))


# ----------------------------------------------- stability and checks of a run


def fold_stability(out_of_fold: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per model: Spearman of the entity forecasts between consecutive periods, and
    1 - coefficient of variation of the R2 over periods."""
    from panelwise.operators.ordered import spearman

    w = Window.partitionBy(ENTITY, "component", "model").orderBy(PERIOD)
    nxt = out_of_fold.withColumns({"_n": F.round(F.lead("yhat").over(w), 10), "_p": F.lead(PERIOD).over(w)})
    pairs = settle(nxt.where(F.col("_p") == F.col(PERIOD) + 1).select("model", "component", PERIOD, F.round("yhat", 10).alias("_y"), "_n"))
    rho = spearman(pairs, ["model", "component", PERIOD], "_y", "_n")
    a = rho.groupBy("model").agg(F.avg("rho").alias("rank_stability"))
    per = E.metric_summary(out_of_fold, ["model", PERIOD])
    b = per.groupBy("model").agg(
        F.greatest(1 - F.coalesce(F.try_divide(F.stddev_pop("rmse"), F.avg("rmse")), lit(0)), lit(0)).alias("score_stability")
    )
    return a.join(b, "model").withColumn("stable", F.col("rank_stability") >= threshold)


def model_agreement(by_model: DataFrame, models: Sequence[str]) -> DataFrame:
    """``(a, b, r)``: correlation of the forecasts of two models."""
    from panelwise.operators.ordered import pearson

    wide = S.wide_forecasts(by_model, models)
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    row = wide.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs]))
    )


def width_stability(predictions: DataFrame) -> DataFrame:
    """1 - coefficient of variation of the interval widths over the components."""
    per = predictions.groupBy("component").agg(F.avg(F.col("upper") - F.col("lower")).alias("w"))
    return per.agg(F.greatest(1 - F.coalesce(F.try_divide(F.stddev_pop("w"), F.avg("w")), lit(0)), lit(0)).alias("width_stability"))


def leave_model_out(by_model: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean absolute change of the mean forecast when one model is left out, and each
    model's mean distance from it. (sum - x) / (n - 1) over a window of the models."""
    w = Window.partitionBy(*keys)
    n, s = F.count("yhat").over(w), F.sum("yhat").over(w)
    rows = by_model.where(F.col("yhat").isNotNull()).withColumns({"_n": n, "_s": s})
    mean = F.col("_s") / F.col("_n")
    without = F.try_divide(F.col("_s") - F.col("yhat"), F.col("_n") - 1)
    return rows.groupBy("model").agg(
        F.avg(F.abs(mean - without)).alias("impact"), F.avg(F.abs(F.col("yhat") - mean)).alias("deviation")
    )


def parametric_bootstrap(
    df: DataFrame, sd: str, seed: int, draws: int = 500, level: float = 0.95, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean, sd and interval of yhat + noise x sd over hashed normal draws.

    The draws of one forecast are an array of its own row: no shuffle, no join."""
    from panelwise.functions.noise import normal

    one = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda i: normal(seed, *[F.col(k) for k in keys], i))
    tail = (1 - level) / 2
    rows = df.where(F.col("yhat").isNotNull()).withColumn("_z", F.array_sort(one))
    mean = F.aggregate("_z", lit(0), lambda a, v: a + v) / draws
    sq = F.aggregate("_z", lit(0), lambda a, v: a + v * v) / draws
    low, high = int(tail * (draws - 1)), int(round((1 - tail) * (draws - 1)))
    s = F.coalesce(F.col(sd), lit(0))
    return rows.select(
        *keys, "yhat",
        (F.col("yhat") + mean * s).alias("mean"),
        (F.sqrt(F.greatest(sq - mean * mean, lit(0))) * s).alias("sd"),
        (F.col("yhat") + F.col("_z")[low] * s).alias("low"),
        (F.col("yhat") + F.col("_z")[high] * s).alias("high"),
    )


def importance_stability(parts: DataFrame, seed: int, draws: int = 100) -> DataFrame:
    """``parts``: ``(component, feature, importance)``. Components are resampled by hashed
    Poisson counts; per feature the CV of the mean importance and the share of draws in
    which its rank stays within max(2, p / 10)."""
    from panelwise.functions.noise import poisson_one

    rows = parts.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    w = poisson_one(seed, F.col("draw"), F.col("component")).cast("double")
    per = rows.withColumn("_w", w).groupBy("draw", "feature").agg(
        F.try_divide(F.sum(F.col("_w") * F.col("importance")), F.sum("_w")).alias("v")
    ).where("v IS NOT NULL")
    base = parts.groupBy("feature").agg(F.avg("importance").alias("_b"))
    # one row per feature of the schema in each window
    rank_base = base.withColumn("_rb", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.col("_b").desc())))
    ranked = per.withColumn("_r", F.rank().over(Window.partitionBy("draw").orderBy(F.col("v").desc())))
    near = F.greatest(lit(2), F.count(F.lit(1)).over(Window.partitionBy("draw")) / lit(10))
    joined = ranked.withColumn("_near", near).join(rank_base, "feature")
    return joined.groupBy("feature").agg(
        F.avg("v").alias("importance"),
        F.coalesce(F.try_divide(F.stddev_pop("v"), F.avg("v")), lit(0)).alias("cv"),
        F.avg((F.abs(F.col("_r") - F.col("_rb")) <= F.col("_near")).cast("double")).alias("rank_stability"),
    )


def forecast_checks(
    out_of_fold: DataFrame, intervals: DataFrame, r2_threshold: float = 0.5, coverage_target: float = 0.9
) -> DataFrame:
    """One row of verdicts: fold stability, coverage of the truth, sharpness, agreement of
    the models, residual shape, autocorrelation and variance ratio, and their mean."""
    per = E.metric_summary(out_of_fold, ["model", PERIOD]).agg(
        F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("sd_r2")
    )
    cover = I.coverage(intervals, []).select("coverage", "mean_width")
    diag = E.residual_diagnostics(out_of_fold).agg(
        F.avg("skewness").alias("skewness"), F.avg("excess_kurtosis").alias("excess_kurtosis"),
        F.avg("durbin_watson").alias("durbin_watson"),
    )
    spread = out_of_fold.groupBy(*KEYS).agg(F.stddev_pop("yhat").alias("_s")).agg(F.avg("_s").alias("disagreement"))
    truth = E.known(out_of_fold).agg(
        F.stddev_pop("y").alias("sd_y"), F.try_divide(F.var_pop("yhat"), F.var_pop("y")).alias("variance_ratio")
    )
    one = per.withColumn("_k", F.lit(1))
    for t in (cover, diag, spread, truth):
        one = one.join(t.withColumn("_k", F.lit(1)), "_k")  # one row each
    ok = {
        "r2_ok": F.col("mean_r2") >= r2_threshold,
        "coverage_ok": F.abs(F.col("coverage") - coverage_target) <= 0.1,
        "sharp_ok": F.col("mean_width") <= 4 * F.col("sd_y"),
        "agreement_ok": F.col("disagreement") <= F.col("sd_y"),
        "shape_ok": (F.abs("skewness") < 1) & (F.abs("excess_kurtosis") < 3),
        "autocorrelation_ok": F.col("durbin_watson").between(1.5, 2.5),
        "variance_ok": F.col("variance_ratio").between(0.25, 4.0),
    }
    score = total(F.coalesce(c, F.lit(False)).cast("double") for c in ok.values()) / len(ok)
    return one.drop("_k").withColumns(ok).withColumn("score", score)


def verdict(checks: DataFrame, ranking_robustness: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Overall verdict of a run, with the names of the failed checks."""
    flags = [c for c in checks.columns if c.endswith("_ok")]
    failed = F.concat_ws(",", *[F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(c[:-3])) for c in flags])
    robust = ranking_robustness.agg(F.avg("robustness")).scalar()
    return checks.select(
        "score", robust.alias("robustness"), failed.alias("warnings"),
        ((F.col("score") >= threshold) & (robust >= threshold)).alias("valid"),
    )


# ------------------------------------------------------------ membership tables


def membership_checks(df: DataFrame) -> DataFrame:
    """Checks of ``(entity, grade, belief)``: range, sum, completeness, entropy."""
    b = F.col("belief")
    per = df.groupBy(ENTITY).agg(
        F.sum(b).alias("total"),
        F.min(((b >= 0) & (b <= 1)).cast("int")).alias("_in"),
        (-F.sum(F.when(b > 0, b * F.log(b)).otherwise(lit(0)))).alias("entropy"),
    )
    return per.select(
        ENTITY, "total", (F.col("_in") == 1).alias("in_range"), (F.col("total") <= 1 + 1e-9).alias("sum_ok"),
        (F.col("total") >= 1 - 1e-6).alias("complete"), "entropy",
    )


def grade_distribution(df: DataFrame) -> DataFrame:
    """Entities by the grade with the largest belief (first grade on ties)."""
    top = df.groupBy(ENTITY).agg(F.min_by("grade", F.struct(-F.round("belief", 9), F.col("grade"))).alias("grade"))
    return top.groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


def membership_stability(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: mean cosine similarity, share with the same leading grade, correlation of
    entropies between two membership tables."""
    from panelwise.operators.ordered import pearson

    both = a.withColumnRenamed("belief", "_a").join(b.withColumnRenamed("belief", "_b"), [ENTITY, "grade"])
    x, y = F.col("_a"), F.col("_b")
    ent = lambda v: -F.sum(F.when(v > 0, v * F.log(v)).otherwise(lit(0)))
    per = both.groupBy(ENTITY).agg(
        F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))).alias("_cos"),
        F.min_by("grade", F.struct(-F.round(x, 9), F.col("grade"))).alias("_ga"),
        F.min_by("grade", F.struct(-F.round(y, 9), F.col("grade"))).alias("_gb"),
        ent(x).alias("_ea"),
        ent(y).alias("_eb"),
    )
    return per.agg(
        F.avg("_cos").alias("cosine"),
        F.avg((F.col("_ga") == F.col("_gb")).cast("double")).alias("same_grade"),
        pearson("_ea", "_eb").alias("entropy_correlation"),
        F.count(F.lit(1)).alias("n"),
    )


def standard_panel(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows complete in all columns, standardised over the panel."""
    rows = df.where(all_of(F.col(c).isNotNull() for c in columns))
    stats = {f"_m_{c}": F.avg(c) for c in columns} | {f"_s_{c}": F.stddev_pop(c) for c in columns}
    out = with_stats(rows, [], stats)
    return out.select(
        ENTITY, PERIOD, *[F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), lit(0)).alias(c) for c in columns]
    )


def long_predictions(predictions: DataFrame, columns: Sequence[str]) -> DataFrame:
    return to_long(predictions, columns)
