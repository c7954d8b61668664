"""Regression models, one per target, on rows that Spark keeps distributed.

Every fitted model is a function from a DataFrame to the same DataFrame with a
``yhat`` column."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from panelwise.functions.guards import lit
from panelwise.operators.evaluate import metric_summary
from panelwise.operators.linear import covariance, linear_expression, moments
from panelwise.operators.moment_fits import penalty_grid
from panelwise.operators.ordered import running_sums
from panelwise.operators.splits import walk_forward
from panelwise.panel import PERIOD
from panelwise.session import settle


@dataclass
class Fitted:
    name: str
    predict: Callable[[DataFrame], DataFrame]
    importance: dict[str, float]
    sigma: float = 0.0


def _vectors(df: DataFrame, x: Sequence[str], invalid: str = "skip") -> DataFrame:
    return VectorAssembler(inputCols=list(x), outputCol="_x", handleInvalid=invalid).transform(df)


def complete(x: Sequence[str]) -> Column:
    """Whether a row has a number in every feature."""
    return F.forall(F.array(*[F.col(c).cast("double") for c in x]), lambda v: v.isNotNull() & ~F.isnan(v))


def _share(values) -> list[float]:
    a = np.abs(np.asarray(values, dtype=float))
    return (a / a.sum() if a.sum() > 0 else a).tolist()


def _ml(name: str, estimator, df: DataFrame, x: Sequence[str], y: str) -> Fitted:
    model = estimator.setFeaturesCol("_x").setLabelCol(y).setPredictionCol("yhat").fit(
        _vectors(df.where(F.col(y).isNotNull()), x)
    )
    raw = model.featureImportances.toArray() if hasattr(model, "featureImportances") else model.coefficients.toArray()

    def predict(new: DataFrame) -> DataFrame:
        """Every row; a row without all features has no prediction."""
        return model.transform(_vectors(new, x, "keep")).drop("_x").withColumn("yhat", F.when(complete(x), F.col("yhat")))

    return Fitted(name, predict, dict(zip(x, _share(raw))))


def elastic_net(df: DataFrame, x: Sequence[str], y: str, penalty: float = 0.01, l1: float = 0.5) -> Fitted:
    return _ml("elastic_net", LinearRegression(regParam=penalty, elasticNetParam=l1, maxIter=100), df, x, y)


def elastic_net_cv(
    df: DataFrame, x: Sequence[str], y: str, penalties: Sequence[float] = (0.001, 0.01, 0.1),
    l1_ratios: Sequence[float] = (0.1, 0.5, 0.9), min_train: int = 3, max_folds: int = 3, period: str = PERIOD,
) -> tuple[Fitted, DataFrame]:
    """Elastic net whose penalty and l1 share are the best of a grid by walk-forward R2.

    Returns the fit on all rows and the grid table: means over folds, all from one pass (:func:`penalty_grid`)."""
    found = settle(penalty_grid(df, x, y, penalties, l1_ratios, min_train, max_folds, period))
    table = settle(found.groupBy("setting").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse")))
    best = found.join(table.orderBy(F.col("r2").desc(), "setting").limit(1).select("setting"), "setting").select("penalty", "l1").first()
    return elastic_net(df, x, y, **(best.asDict() if best else {})), table


def grid_search(
    fit: Callable[..., Fitted], grid: Sequence[dict], df: DataFrame, x: Sequence[str], y: str,
    min_train: int = 3, max_folds: int = 3, period: str = PERIOD,
) -> tuple[DataFrame, dict]:
    """Mean walk-forward R2 of every setting; the predictions of all settings and folds are
    scored in one aggregation."""
    tagged = settle(walk_forward(df.where(F.col(y).isNotNull()), period, min_train, max_folds))
    folds = [r["fold"] for r in tagged.select("fold").distinct().orderBy("fold").collect()]
    scored = None
    for i, setting in enumerate(grid):
        for f in folds:
            part = tagged.where(F.col("fold") == f)
            model = fit(part.where("role = 'train'"), x, y, **setting)
            rows = model.predict(part.where("role = 'validate'")).select(
                F.lit(i).alias("setting"), "fold", F.col(y).alias("y"), "yhat"
            )
            scored = rows if scored is None else scored.unionByName(rows)
    table = metric_summary(scored, ["setting", "fold"]).groupBy("setting").agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse"))
    table = settle(table)
    top = table.orderBy(F.col("r2").desc(), "setting").first()["setting"]
    return table, dict(grid[top])


def bayesian_ridge(df: DataFrame, x: Sequence[str], y: str, weight: str | None = None, rounds: int = 100) -> Fitted:
    """Ridge whose penalty and noise level follow from the evidence; p x p updates from one
    pass of sums of products. ``sigma`` is the residual sd."""
    mean, cov, n = covariance(moments(df, [*x, y], weight))
    p = len(x)
    xx, xy, yy = cov[:p, :p] * n, cov[:p, p] * n, cov[p, p] * n
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    proj = vectors.T @ xy
    noise, prior = 1.0 / max(cov[p, p], 1e-12), 1.0
    beta = np.zeros(p)
    for _ in range(rounds):
        old = beta
        beta = vectors @ (proj / (values + prior / noise))
        gamma = float(np.sum(noise * values / (prior + noise * values)))
        rss = max(float(yy - 2 * beta @ xy + beta @ xx @ beta), 1e-12)
        prior = (gamma + 2e-6) / (float(beta @ beta) + 2e-6)
        noise = (n - gamma + 2e-6) / (rss + 2e-6)
        if np.abs(beta - old).sum() < 1e-8:
            break
    line = linear_expression(x, float(mean[p] - mean[:p] @ beta), beta)
    sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0.0))
    return Fitted("bayesian_ridge", lambda new: new.withColumn("yhat", line), dict(zip(x, _share(beta * sd))), float(np.sqrt(1 / noise)))


def boosted_trees(
    df: DataFrame, x: Sequence[str], y: str, iterations: int = 30, depth: int = 4, leaf: int = 5, rate: float = 0.1,
    validation: float = 0.2, period: str = PERIOD,
) -> Fitted:
    """Gradient boosting with trees of ``depth`` levels and ``leaf`` rows a leaf at least; the latest
    periods (about ``validation`` of them) stop the boosting early."""
    rows = df.where(F.col(y).isNotNull())
    first, last = rows.agg(F.min(period), F.max(period)).first()
    cut = last - max(1, round((last - first) * validation))
    flagged = rows.withColumn("_late", F.col(period) > cut)
    estimator = GBTRegressor(
        maxIter=iterations, maxDepth=depth, stepSize=rate, minInstancesPerNode=leaf, seed=42
    )
    if last > first:
        estimator = estimator.setValidationIndicatorCol("_late")
    return _ml("boosted_trees", estimator, flagged, x, y)


def fourier_ridge(
    df: DataFrame, x: Sequence[str], y: str, features: int = 40, gamma: float | None = None, penalty: float = 0.1, seed: int = 42
) -> Fitted:
    """Kernel ridge with a Gaussian kernel through random Fourier features: a projection and
    a linear fit in place of an n x n kernel matrix."""
    gamma = gamma or 1.0 / len(x)
    rng = np.random.default_rng(seed)
    omega = rng.normal(0.0, math.sqrt(2 * gamma), (len(x), features))
    phase = rng.uniform(0, 2 * math.pi, features)

    def lift(rows: np.ndarray) -> np.ndarray:
        return np.cos(rows @ omega + phase)

    m = moments(df, [*x, y], lift=lift, n_lifted=len(x), n_out=features)
    mean, cov, n = covariance(m)
    beta = np.linalg.solve(cov[:features, :features] + penalty / max(n, 1) * np.eye(features), cov[:features, features])
    intercept = float(mean[features] - mean[:features] @ beta)

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series(lift(np.column_stack([c.to_numpy(float) for c in cols])) @ beta + intercept)

    return Fitted("fourier_ridge", lambda new: new.withColumn("yhat", score(*[F.col(c) for c in x])), {})


@dataclass
class QuantileForest:
    """Random forest whose leaves keep the distribution of the target.

    A leaf is one row with an array of at most 2 * ``cells`` values and their shares, so a row
    meets one row for each tree and never training rows."""

    model: object
    leaves: DataFrame
    x: list[str]

    def quantiles(self, df: DataFrame, keys: Sequence[str], levels: dict[str, float]) -> DataFrame:
        """Mean and quantiles of the leaves that a key's rows fall into. Only leaf numbers are shuffled, one for each tree; the
        leaves, at most trees x 2 ** depth rows, go to every task, and rows of the same leaves are worked out once a batch."""
        rows = _placed(self.model, df, self.x).select(*keys, vector_to_array("_leaf").cast("array<int>").alias("_leaf"))
        per = rows.groupBy(*keys).agg(F.flatten(F.collect_list("_leaf")).alias("_leaf"))
        trees, known, names = self.model.getNumTrees, {}, ["mean", *levels]
        for r in self.leaves.select("tree", "leaf", F.col("cells.value").alias("value"), F.col("cells.share").alias("share")).toLocalIterator():
            known[r["tree"], int(r["leaf"])] = np.array(r["value"], float), np.array(r["share"], float)
        shared = df.sparkSession.sparkContext.broadcast(known)
        at = np.array(list(levels.values()), float)

        def measures(leaves: tuple) -> np.ndarray | None:
            found = [shared.value[i % trees, v] for i, v in enumerate(leaves) if (i % trees, v) in shared.value]
            if not found:
                return None
            value, share = (np.concatenate(p) for p in zip(*found, strict=True))
            order = np.argsort(value, kind="stable")
            value, share = value[order], share[order]
            upto = np.cumsum(share)
            first = np.searchsorted(upto, at * upto[-1] - 1e-9)
            return np.r_[share @ value / upto[-1], value[np.minimum(first, len(value) - 1)]]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: dict[tuple, np.ndarray] = {}
                keys_ = [tuple(v) for v in batch.column("_leaf").to_pylist()]
                for leaves in keys_:
                    if leaves not in seen:
                        seen[leaves] = measures(leaves)
                kept = [i for i, v in enumerate(keys_) if seen[v] is not None]
                out = np.array([seen[keys_[i]] for i in kept]).reshape(len(kept), len(names))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(kept, pa.int64())) for k in keys], *[pa.array(c) for c in out.T]], names=[*keys, *names])

        schema = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(n, T.DoubleType()) for n in names]])
        return per.mapInArrow(score, schema)


def _placed(model, df: DataFrame, x: Sequence[str]) -> DataFrame:
    return model.setLeafCol("_leaf").transform(_vectors(df, x))


def _leaves(model, df: DataFrame, x: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return _placed(model, df, x).select(*keys, F.posexplode(vector_to_array("_leaf")).alias("tree", "leaf"))


def quantile_forest(df: DataFrame, x: Sequence[str], y: str, keys: Sequence[str], trees: int = 20, depth: int = 5, cells: int = 128, limit: int | None = None) -> QuantileForest:
    """A forest whose leaves keep every value with its share while they are at most ``cells`` many; else
    values next to each other by rank are one cell, at their mean; a value of more than 1 / ``cells`` of the rows has its own.
    A cell of several values holds less than 2 / ``cells`` of the leaf's rows, so ranks are off by less than
    that share wherever the target lies and whatever its scale."""
    rows = df.where(F.col(y).isNotNull())
    model = RandomForestRegressor(featuresCol="_x", labelCol=y, numTrees=trees, maxDepth=depth, seed=42).fit(_vectors(rows, x))
    place = ["tree", "leaf"]
    counts = settle(_leaves(model, rows, x, [*keys, y]).groupBy(*place, F.col(y).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("_n")))
    sizes = counts.groupBy(*place).agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_values"))
    run = running_sums(counts, place, "value", {"_upto": F.col("_n")}, limit).join(sizes, place)
    before = (F.col("_upto") - F.col("_n")) * cells
    heavy = F.col("_n") * cells > F.col("_t")
    own = F.struct(F.when((F.col("_values") <= cells) | heavy, F.col("value")).alias("value"), F.floor(before / F.col("_t")).alias("slot"))
    merged = run.groupBy(*place, own.alias("_own")).agg(
        (F.sum(F.col("value") * F.col("_n")) / F.sum("_n")).alias("value"), (F.sum("_n") / F.first("_t")).alias("share")
    )
    kept = merged.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("value", "share"))).alias("cells"))
    return QuantileForest(model, settle(kept), list(x))


def mean_importance(parts: Sequence[dict[str, float]]) -> dict[str, float]:
    """Importances averaged over models and components, each normalised first."""
    names = sorted({n for p in parts for n in p})
    kept = [p for p in parts if p]
    return {n: sum(p.get(n, 0.0) for p in kept) / len(kept) for n in names} if kept else {}


MODELS: dict[str, Callable[..., Fitted]] = {
    "elastic_net": elastic_net,
    "bayesian_ridge": bayesian_ridge,
    "boosted_trees": boosted_trees,
    "fourier_ridge": fourier_ridge,
}
