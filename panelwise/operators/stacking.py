"""Combining model forecasts. Input is long: keys, ``component``, ``model``, ``y``, ``yhat``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from panelwise.functions.guards import clip, lit, ratio, total
from panelwise.functions.noise import by_key, poisson_key, uniform, with_counts
from panelwise.operators.evaluate import known, metric_summary
from panelwise.operators.linear import covariance, moment_rows, moments
from panelwise.operators.splits import fold_table
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle, together

KEYS = (ENTITY, PERIOD, "component")


def wide_forecasts(df: DataFrame, models: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per target with a column per model."""
    return df.groupBy(*keys).agg(
        F.max("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(m) for m in models]
    )


def out_of_fold(
    df: DataFrame, fits: Mapping[str, Callable], x: Sequence[str], targets: Mapping[str, str], keys: Sequence[str],
    min_train: int = 3, max_folds: int = 3, period: str = PERIOD,
) -> DataFrame:
    """``(fold, keys.., component, y, model, yhat)`` of every model, component and
    walk-forward fold. ``targets``: component -> target column. Rows are tagged once; fits run several at a time."""
    folds = [tuple(r) for r in fold_table(df, period, min_train, max_folds).orderBy("fold").collect()]

    def forecast(fold: int, at: int, component: str, name: str) -> DataFrame:
        y = targets[component]
        known_y = F.col(y).isNotNull()
        train = df.where((F.col(period) < at) & known_y)
        validate = df.where((F.col(period) == at) & known_y)
        return fits[name](train, x, y).predict(validate).select(
            F.lit(fold).alias("fold"), *keys, F.lit(component).alias("component"), F.col(y).alias("y"),
            F.lit(name).alias("model"), "yhat",
        )

    tasks = [partial(forecast, fold, at, c, name) for fold, at in folds for c in targets for name in fits]
    parts = together(df.sparkSession, tasks)
    return reduce(DataFrame.unionByName, parts) if parts else None


def extend_residuals(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary out-of-fold forecasts, and for targets they lack the secondary sweep."""
    missing = secondary.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    return primary.unionByName(missing.select(*primary.columns))


def _weight_table(spark, weights: Mapping, names: Sequence[str]) -> DataFrame:
    rows = [(c, m, float(w)) for c, ws in sorted(weights.items()) for m, w in zip(names, ws)]
    return spark.createDataFrame(rows, "component string, model string, weight double")


def ridge_weights(df: DataFrame, models: Sequence[str], penalty: float = 1e-3) -> DataFrame:
    """``(component, model, weight)``: ridge of y on the model forecasts without intercept,
    negative weights cut to 0, normalised. K x K sums per component come from one pass."""
    rows = wide_forecasts(known(df), models)
    k = len(models)
    grams: dict = {}
    for row in moment_rows(rows, [*models, "y"], ["component"]).toLocalIterator():
        m = grams.setdefault(row["component"], np.zeros((k + 2, k + 2)))
        m[row["i"], row["j"]] = m[row["j"], row["i"]] = row["s"]
    return _weight_table(df.sparkSession, {c: _shares(m, penalty) for c, m in grams.items()}, models)


def _shares(m: np.ndarray, penalty: float) -> np.ndarray:
    """Normalised weights from the sums of products of (1, forecasts.., y)."""
    k = len(m) - 2
    a = m[1 : k + 1, 1 : k + 1] + penalty * max(m[0, 0], 1.0) * np.eye(k)
    w = np.maximum(np.linalg.solve(a, m[1 : k + 1, k + 1]), 0.0)
    return w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)


def ridge_weights_so_far(df: DataFrame, models: Sequence[str], penalty: float = 1e-3) -> DataFrame:
    """``(component, period, model, weight)``: for every period the ridge weights of all periods before it, equal
    weights where there is none. One pass; K x K sums for each component and period reach the driver."""
    k = len(models)
    grams: dict = {(r["component"], r[PERIOD]): np.zeros((k + 2, k + 2)) for r in df.select("component", PERIOD).distinct().collect()}
    for row in moment_rows(wide_forecasts(known(df), models), [*models, "y"], ["component", PERIOD]).toLocalIterator():
        m = grams[row["component"], row[PERIOD]]
        m[row["i"], row["j"]] = m[row["j"], row["i"]] = row["s"]
    before: dict = {}
    rows = []
    for (c, p), m in sorted(grams.items()):
        sums = before.setdefault(c, np.zeros_like(m))
        w = _shares(sums, penalty) if sums[0, 0] > 0 else np.full(k, 1 / k)
        rows += [(c, p, name, float(x)) for name, x in zip(models, w, strict=True)]
        before[c] = sums + m
    kind = df.schema[PERIOD].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"component string, {PERIOD} {kind}, model string, weight double")


def non_negative_weights(gram: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Least squares with weights >= 0 on a K x K problem, by coordinate descent."""
    w = np.zeros(len(target))
    for _ in range(rounds):
        old = w.copy()
        for i in range(len(w)):
            if gram[i, i] > 0:
                w[i] = max(0.0, (target[i] - gram[i] @ w + gram[i, i] * w[i]) / gram[i, i])
        if np.abs(w - old).max() < 1e-12:
            break
    return w


def softmax_weights(scores: DataFrame, temperature: float = 0.1) -> DataFrame:
    """``(component, model, weight)`` from a score per component and model (R2)."""
    w = Window.partitionBy("component")
    z = F.exp((F.col("r2") - F.max("r2").over(w)) / lit(temperature))
    return scores.withColumn("_z", z).select("component", "model", (F.col("_z") / F.sum("_z").over(w)).alias("weight"))


def score_weights(scores: DataFrame) -> DataFrame:
    """Fallback: mean R2 of a model, floored at 0, as a share; equal if all are 0."""
    mean = scores.groupBy("model").agg(F.greatest(F.avg("r2"), lit(0)).alias("_s"))
    w = Window.partitionBy(F.lit(0))
    whole, n = F.sum("_s").over(w), F.count(F.lit(1)).over(w)
    return mean.select("model", F.when(whole > 0, ratio(F.col("_s"), whole)).otherwise(1 / n).alias("weight"))


def log_score_weights(df: DataFrame, models: Sequence[str], rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """Weights of the Gaussian mixture of model forecasts with the largest mean log score,
    per component. Each step is one aggregation; the state is K numbers per component."""
    rows = settle(wide_forecasts(known(df), models).where(" AND ".join(f"`{m}` IS NOT NULL" for m in models)))
    sds = rows.groupBy("component").agg(*[F.sqrt(F.avg(F.pow(F.col("y") - F.col(m), lit(2)))).alias(f"s_{m}") for m in models])
    sds = settle(sds)
    dens = {
        m: F.exp(-F.pow(F.col("y") - F.col(m), lit(2)) / (2 * F.pow(F.greatest(F.col(f"s_{m}"), lit(1e-9)), lit(2))))
        / F.greatest(F.col(f"s_{m}"), lit(1e-9))
        for m in models
    }
    rows = settle(rows.join(sds, "component").select("component", *[d.alias(f"d_{m}") for m, d in dens.items()]))
    weights = {r["component"]: np.full(len(models), 1 / len(models)) for r in rows.select("component").distinct().collect()}
    for _ in range(rounds):
        table = df.sparkSession.createDataFrame(
            [(c, *map(float, w)) for c, w in weights.items()], "component string, " + ", ".join(f"w_{m} double" for m in models)
        )
        placed = rows.join(table, "component")
        mix = total(F.col(f"w_{m}") * F.col(f"d_{m}") for m in models)
        new = placed.groupBy("component").agg(
            *[F.avg(F.coalesce(ratio(F.col(f"w_{m}") * F.col(f"d_{m}"), mix), lit(1 / len(models)))).alias(m) for m in models]
        ).collect()
        moved = 0.0
        for r in new:
            w = np.array([r[m] for m in models])
            moved = max(moved, float(np.abs(w - weights[r["component"]]).max()))
            weights[r["component"]] = w
        if moved < tolerance:
            break
    return _weight_table(df.sparkSession, weights, models)


def share_across_components(weights: DataFrame, strength: float = 0.3) -> DataFrame:
    """Weights shrunk towards the model's mean over the components, renormalised."""
    mean = F.avg("weight").over(Window.partitionBy("model"))
    mixed = weights.withColumn("_w", (1 - strength) * F.col("weight") + strength * mean)
    whole = F.sum("_w").over(Window.partitionBy("component"))
    return mixed.select("component", "model", ratio(F.col("_w"), whole).alias("weight"))


def weight_spread(df: DataFrame, models: Sequence[str], seed: int, resamples: int = 200, penalty: float = 1e-3) -> DataFrame:
    """Sd of the ridge weights when whole entities are resampled.

    An entity's counts in the resamples are hashes, drawn once in the task that holds its rows. Each task turns its rows into
    resample-weighted sums (resamples x K x K numbers per component), so neither the
    rows nor the shuffle grow with the number of resamples."""
    names = [*models, "y"]
    rows = wide_forecasts(known(df), models).where(" AND ".join(f"`{n}` IS NOT NULL" for n in names))
    k = len(names)

    def partial(batches):
        sums: dict[str, np.ndarray] = {}
        for piece, counts in with_counts(batches, "_key", seed, resamples, 10_000):
            for c, part in piece.reset_index(drop=True).groupby("component", sort=False):
                v = part[names].to_numpy(float)
                outer = (v[:, :, None] * v[:, None, :]).reshape(len(v), k * k)
                sums[c] = sums.get(c, 0.0) + counts[part.index].T.astype(float) @ np.column_stack([outer, np.ones(len(v))])
        for c, m in sums.items():
            yield pd.DataFrame({"component": c, "replicate": range(len(m)), "sums": list(m)})

    drawn = by_key(rows.select("component", *names, poisson_key(F.col(ENTITY)).alias("_key")), "_key")
    parts = drawn.mapInPandas(partial, "component string, replicate int, sums array<double>")
    whole = parts.select("component", "replicate", F.posexplode("sums").alias("i", "s")).groupBy("component", "replicate", "i").agg(F.sum("s").alias("s"))
    state: dict = {}
    for row in whole.toLocalIterator():
        state.setdefault((row["component"], row["replicate"]), np.zeros(k * k + 1))[row["i"]] = row["s"]
    per: dict = {}
    for (c, _), m in state.items():
        gram = m[:-1].reshape(k, k)
        a = gram[: k - 1, : k - 1] + penalty * max(m[-1], 1.0) * np.eye(k - 1)
        w = np.maximum(np.linalg.solve(a, gram[: k - 1, k - 1]), 0.0)
        per.setdefault(c, []).append(w / w.sum() if w.sum() > 0 else np.full(k - 1, 1 / (k - 1)))
    rows_out = [
        (c, m, float(np.mean([w[i] for w in ws])), float(np.std([w[i] for w in ws])))
        for c, ws in sorted(per.items()) for i, m in enumerate(models)
    ]
    return df.sparkSession.createDataFrame(rows_out, "component string, model string, mean double, sd double")


def ensemble(df: DataFrame, weights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Weighted mean forecast and disagreement (weighted sd) over the models present.

    Weights are by those of component, model and period that they name."""
    on = [c for c in ("component", "model", PERIOD) if c in weights.columns]
    rows = df.where(F.col("yhat").isNotNull()).join(weights, on)
    w, p = F.col("weight"), F.col("yhat")
    agg = rows.groupBy(*keys).agg(
        F.max("y").alias("y"), F.sum(w).alias("_w"), F.sum(w * p).alias("_wp"), F.sum(w * p * p).alias("_wpp")
    ).where("_w > 0")
    mean = F.col("_wp") / F.col("_w")
    var = F.greatest(F.col("_wpp") / F.col("_w") - mean * mean, lit(0))
    return agg.select(*keys, "y", mean.alias("yhat"), F.sqrt(var).alias("disagreement"))


def blend_weights(old: DataFrame, new: DataFrame, gamma: float = 0.3) -> DataFrame:
    """(1 - gamma) old + gamma new, renormalised per component."""
    both = old.withColumnRenamed("weight", "_old").join(new.withColumnRenamed("weight", "_new"), ["component", "model"], "full_outer")
    mixed = (1 - gamma) * F.coalesce("_old", lit(0)) + gamma * F.coalesce("_new", lit(0))
    whole = F.sum("_w").over(Window.partitionBy("component"))
    return both.withColumn("_w", mixed).select("component", "model", ratio(F.col("_w"), whole).alias("weight"))


def update_weights(df: DataFrame, old: DataFrame, models: Sequence[str], gamma: float = 0.3) -> DataFrame:
    """New period: non-negative least squares on its rows, blended into the old weights."""
    rows = wide_forecasts(known(df), models)
    k = len(models)
    grams: dict = {}
    for row in moment_rows(rows, [*models, "y"], ["component"]).toLocalIterator():
        m = grams.setdefault(row["component"], np.zeros((k + 2, k + 2)))
        m[row["i"], row["j"]] = m[row["j"], row["i"]] = row["s"]
    weights = {}
    for c, m in grams.items():
        w = non_negative_weights(m[1 : k + 1, 1 : k + 1], m[1 : k + 1, k + 1])
        weights[c] = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)
    return blend_weights(old, _weight_table(df.sparkSession, weights, models), gamma)


# ------------------------------------------------------------ covariate shift


def shift_statistic(
    df: DataFrame, columns: Sequence[str], label: str, bandwidth: float | None = None, features: int = 64,
    permutations: int = 50, seed: int = 7, keys: Sequence[str] = (ENTITY, PERIOD),
) -> DataFrame:
    """Squared distance of the kernel mean embeddings of two groups of rows (``label`` 0/1),
    and the 95 % point under random relabelling.

    The Gaussian kernel is expanded in random Fourier features, so the statistic is a
    difference of means: one pass gives it for the true and all permuted labels,
    with no pairs of rows and no copies of rows."""
    p = len(columns)
    _, cov, _ = covariance(moments(df, columns))
    h = bandwidth or float(np.sqrt(max(2 * np.trace(cov), 1e-12)))
    omega = np.random.default_rng(seed).normal(0.0, 1.0 / h, (p, features))
    share = df.agg(F.avg(F.col(label).cast("double"))).first()[0]
    # label of every run: the true one first, then hashed draws with the same share
    drawn = F.transform(
        F.sequence(F.lit(1), F.lit(permutations)),
        lambda i: (uniform(seed, i, *[F.col(k) for k in keys]) < share).cast("double"),
    )
    rows = df.select(*columns, F.concat(F.array(F.col(label).cast("double")), drawn).alias("_g"))

    def partial(batches):
        one = zero = None
        for pdf in batches:
            z = pdf[list(columns)].to_numpy(float) @ omega
            f = np.column_stack([np.cos(z), np.sin(z), np.ones(len(z))])
            g = np.stack(pdf["_g"].to_numpy())
            one = g.T @ f if one is None else one + g.T @ f
            zero = (1 - g).T @ f if zero is None else zero + (1 - g).T @ f
        if one is not None:
            for tag, m in ((1, one), (0, zero)):
                yield pd.DataFrame({"run": range(len(m)), "g": tag, "sums": list(m)})

    parts = rows.mapInPandas(partial, "run int, g int, sums array<double>")
    sums = parts.select("run", "g", F.posexplode("sums").alias("i", "s")).groupBy("run", "g", "i").agg(F.sum("s").alias("s"))
    sizes = sums.where(F.col("i") == 2 * features).select("run", "g", F.col("s").alias("_n"))
    means = sums.where(F.col("i") < 2 * features).join(sizes, ["run", "g"]).groupBy("run", "i").agg(
        F.sum(F.when(F.col("g") == 1, F.col("s") / F.col("_n")).otherwise(-F.col("s") / F.col("_n"))).alias("d")
    )
    stat = means.groupBy("run").agg((F.sum(F.col("d") * F.col("d")) / features).alias("mmd2"))
    null = F.percentile(F.when(F.col("run") > 0, F.col("mmd2")), F.lit(0.95))
    out = stat.agg(F.max(F.when(F.col("run") == 0, F.col("mmd2"))).alias("mmd2"), null.alias("threshold"))
    return out.withColumn("shifted", F.col("mmd2") > F.col("threshold"))


def importance_weights(df: DataFrame, columns: Sequence[str], label: str, low: float = 0.1, high: float = 10.0) -> DataFrame:
    """Density ratio p / (1 - p) of a logistic classifier of new (1) against old (0) rows,
    for the old rows, clipped, with mean 1. A row without all features teaches nothing and has weight 1."""
    whole = F.forall(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull() & ~F.isnan(v))
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="keep").transform(df.withColumn("_whole", whole))
    model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.01).fit(vectors.where("_whole").withColumn("_y", F.col(label).cast("double")))
    p = vector_to_array("probability")[1]
    rows = model.transform(vectors).where(~F.col(label).cast("boolean")).withColumn("_w", F.when(F.col("_whole"), clip(ratio(p, 1 - p), low, high)))
    rows = settle(rows.select(*df.columns, "_w"))
    mean = rows.agg(F.avg("_w")).scalar()
    return rows.select(*df.columns, F.coalesce(F.col("_w") / mean, F.lit(1.0)).alias("importance_weight"))


def fold_scores(df: DataFrame) -> DataFrame:
    """R2 per component, model and fold."""
    return metric_summary(df, ["component", "model", "fold"]).select("component", "model", "fold", "r2")
