"""Forecast metrics. Input is long: ``y``, ``yhat`` and any group columns.

Every metric is a grouped aggregate with map-side partial sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelwise.functions.guards import lit, ratio
from panelwise.functions.noise import by_key, poisson_key, poisson_one, with_counts
from panelwise.operators.ordered import group_quantiles, pearson, top_n
from panelwise.operators.passes import attach, with_stats
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle

Y, YHAT = F.col, F.col


def known(df: DataFrame) -> DataFrame:
    return df.where(F.col("y").isNotNull() & F.col("yhat").isNotNull())


def metrics() -> dict[str, Column]:
    """Name -> aggregate over y and yhat."""
    y, p = F.col("y"), F.col("yhat")
    err = y - p
    tot = F.var_pop(y) * F.count(y)
    res = F.sum(err * err)
    size = F.when(F.abs(y) < 1e-9, lit(1)).otherwise(F.abs(y))
    return {
        "r2": F.when(tot < 1e-12, F.when(res < 1e-12, lit(1)).otherwise(lit(0))).otherwise(1 - ratio(res, tot)),
        "rmse": F.sqrt(F.avg(err * err)),
        "mae": F.avg(F.abs(err)),
        "mape": 100 * F.avg(F.abs(err) / size),
        "bias": F.avg(err),
        "correlation": F.coalesce(pearson("y", "yhat"), lit(0)),
    }


def metric_summary(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    return known(df).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), *[m.alias(name) for name, m in metrics().items()]
    )


def compare_models(df: DataFrame, metric: str = "r2") -> DataFrame:
    """Metrics per model, position by the metric, best flag."""
    table = metric_summary(df, ["model"])
    w = Window.partitionBy(F.lit(0)).orderBy(F.round(metric, 9).desc(), F.col("model"))
    return table.withColumn("position", F.row_number().over(w)).withColumn("best", F.col("position") == 1)


def fold_summary(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean, sd, min and max of each metric over the folds, per model."""
    per = metric_summary(df, ["model", fold])
    aggs = []
    for m in ("r2", "rmse", "mae"):
        aggs += [
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_pop(m).alias(f"{m}_sd"),
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
        ]
    return per.groupBy("model").agg(F.count(F.lit(1)).alias("n_folds"), *aggs)


def residual_diagnostics(df: DataFrame, group: Sequence[str] = ("model",), fold: str = PERIOD) -> DataFrame:
    """Zero mean, Durbin-Watson averaged over (entity, component) series, spread against
    level, skewness and excess kurtosis of the residuals."""
    r = F.col("y") - F.col("yhat")
    rows = known(df).withColumn("_r", r)
    w = Window.partitionBy(*group, ENTITY, "component").orderBy(fold)
    steps = rows.withColumn("_d", F.col("_r") - F.lag("_r").over(w))
    series = steps.groupBy(*group, ENTITY, "component").agg(
        (F.sum(F.col("_d") * F.col("_d")) / (F.sum(F.col("_r") * F.col("_r")) + 1e-10)).alias("_dw"),
        F.count(F.lit(1)).alias("_n"),
    )
    dw = series.where("_n > 2").groupBy(*group).agg(F.avg("_dw").alias("durbin_watson"))
    n, mean, sd = F.count(F.lit(1)), F.avg("_r"), F.stddev_pop("_r")
    shape = rows.withColumn("_a", F.abs("_r")).groupBy(*group).agg(
        n.alias("n"),
        mean.alias("mean"),
        sd.alias("sd"),
        (F.abs(mean) < 2 * sd / F.sqrt(n)).alias("mean_is_zero"),
        pearson("yhat", "_a").alias("spread_correlation"),
        F.skewness("_r").alias("skewness"),
        F.kurtosis("_r").alias("excess_kurtosis"),
    )
    return shape.join(dw, list(group), "left")


def interval_quality(df: DataFrame, group: Sequence[str] = (), target: float = 0.9) -> DataFrame:
    """Coverage, gap, widths and Winkler score of ``lower``/``upper`` against y."""
    alpha = 1 - target
    y, lo, hi = F.col("y"), F.col("lower"), F.col("upper")
    width = hi - lo
    score = (
        width
        + F.when(y < lo, lit(2 / alpha) * (lo - y)).otherwise(lit(0))
        + F.when(y > hi, lit(2 / alpha) * (y - hi)).otherwise(lit(0))
    )
    rows = settle(df.where(y.isNotNull() & lo.isNotNull() & hi.isNotNull()).withColumns({"_w": width, "_s": score}))
    cover = F.avg(((y >= lo) & (y <= hi)).cast("double"))
    stats = rows.groupBy(*group).agg(
        cover.alias("coverage"),
        (cover - target).alias("gap"),
        F.avg("_w").alias("mean_width"),
        F.stddev_pop("_w").alias("sd_width"),
        F.avg("_s").alias("winkler"),
    )
    # widths on a grid: sums of different order must not make equal widths unequal
    median = group_quantiles(rows.withColumn("_w", F.round("_w", 10)), group, "_w", {"median_width": 0.5})
    return stats.join(median, list(group)) if group else stats.withColumn("_k", F.lit(1)).join(median.withColumn("_k", F.lit(1)), "_k").drop("_k")


def width_summary(df: DataFrame, group: Sequence[str] = ("component",)) -> DataFrame:
    rows = settle(df.withColumn("_w", F.round(F.col("upper") - F.col("lower"), 10)).where("_w IS NOT NULL"))
    stats = rows.groupBy(*group).agg(F.avg("_w").alias("mean_width"), F.min("_w").alias("min_width"), F.max("_w").alias("max_width"))
    return stats.join(group_quantiles(rows, group, "_w", {"median_width": 0.5}).drop("n"), list(group))


def calibration_curve(df: DataFrame, levels: Mapping[str, float]) -> DataFrame:
    """``(level, observed)``: share of y at or below each predicted quantile column."""
    row = df.where(F.col("y").isNotNull()).agg(*[F.avg((F.col("y") <= F.col(c)).cast("double")).alias(c) for c in levels])
    cells = F.array(*[F.struct(lit(q).alias("level"), F.col(c).alias("observed")) for c, q in levels.items()])
    return row.select(F.inline(cells)).withColumn("error", F.abs(F.col("level") - F.col("observed")))


def entity_errors(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Error per entity; percentage errors only where |y| > 0.01."""
    err = F.col("y") - F.col("yhat")
    pct = F.when(F.abs("y") > 1e-2, F.abs(err) / F.abs("y") * 100)
    return known(df).groupBy(*group, ENTITY).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(pct).alias("mape")
    )


def worst_predictions(df: DataFrame, k: int = 20) -> DataFrame:
    """The k largest absolute errors; a global top-k keeps k rows per task."""
    rows = known(df).withColumn("abs_error", F.round(F.abs(F.col("y") - F.col("yhat")), 10))
    keys = [c for c in (ENTITY, PERIOD, "component", "model") if c in df.columns]
    return rows.orderBy(F.col("abs_error").desc(), *keys).limit(k)


def order_quantile(df: DataFrame, group: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """Conformal quantile as an order statistic: value number ceil((n+1)(1-alpha)), within 1..n."""
    rows = settle(known(df).withColumn("_r", F.round(F.abs(F.col("y") - F.col("yhat")), 10)))
    n = F.col("n").cast("double")
    pos = F.least(F.greatest(F.ceil((n + 1) * (1 - alpha)), F.lit(1)), F.col("n"))
    level = F.when(F.col("n") > 1, (pos - 1).cast("double") / (n - 1)).otherwise(lit(0))
    q = group_quantiles(rows, group, "_r", {"quantile": level})
    joined = attach(rows, settle(q), group)
    return joined.groupBy(*group).agg(
        F.first("n").alias("n"),
        F.first("quantile").alias("quantile"),
        F.avg((F.col("_r") <= F.col("quantile") + 1e-12).cast("double")).alias("coverage"),
        (2 * F.first("quantile")).alias("width"),
    )


def skill(table: DataFrame, baseline: str) -> DataFrame:
    """(R2 - R2 of the baseline) / (1 - R2 of the baseline), one row per other model."""
    base = table.where(F.col("model") == baseline).agg(F.first("r2")).scalar()
    return table.where(F.col("model") != baseline).select("model", "r2", ratio(F.col("r2") - base, 1 - base).alias("skill"))


def ablation(df: DataFrame, models: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean prediction of each model subset (single, leave one out, pairs, all), scored.

    The subsets are schema: one row per target holds all model columns, one
    aggregation scores every subset."""
    wide = known(df).groupBy(*keys).agg(
        F.max("y").alias("y"), *[F.max(F.when(F.col("model") == m, F.col("yhat"))).alias(m) for m in models]
    )
    subsets: dict[str, list[str]] = {"all": list(models)}
    subsets |= {f"only {m}": [m] for m in models}
    if len(models) > 2:
        subsets |= {f"without {m}": [x for x in models if x != m] for m in models}
    subsets |= {f"{a} + {b}": [a, b] for i, a in enumerate(models) for b in models[i + 1 :]}
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("subset"), (sum((F.col(m) for m in ms[1:]), F.col(ms[0])) / len(ms)).alias("yhat"))
            for n, ms in subsets.items()
        ]
    )
    rows = wide.select("y", F.inline(cells))
    return metric_summary(rows, ["subset"]).select("subset", "n", "r2", "rmse", "mae")


def bootstrap(
    df: DataFrame,
    group: Sequence[str],
    keys: Sequence[str],
    seed: int,
    metric: Callable[[Column, Column, Column], Column] | None = None,
    resamples: int = 1000,
    level: float = 0.95,
) -> DataFrame:
    """Interval of a metric by resampling rows with Poisson(1) counts from a hash of
    (replicate, key): no resample is gathered, each replicate is a weighted aggregate.

    The default is the mean absolute error: tasks keep its sums for all replicates and no row is copied. Any other
    ``metric(w, y, yhat)``, a weighted aggregate, copies a row for each replicate that draws it."""
    per = _error_replicates(df, list(group), keys, seed, resamples) if metric is None else _replicates(df, group, keys, seed, metric, resamples)
    tail = (1 - level) / 2
    # one value per replicate
    return per.groupBy(*group).agg(
        F.avg("value").alias("mean"),
        F.percentile("value", F.lit(tail)).alias("low"),
        F.percentile("value", F.lit(1 - tail)).alias("high"),
    )


def _replicates(df: DataFrame, group: Sequence[str], keys: Sequence[str], seed: int, metric: Callable, resamples: int) -> DataFrame:
    rows = known(df).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    w = poisson_one(seed, F.col("replicate"), *[F.col(k) for k in keys])
    return rows.withColumn("_w", w).where("_w > 0").groupBy(*group, "replicate").agg(
        metric(F.col("_w"), F.col("y"), F.col("yhat")).alias("value")
    )


def _error_replicates(df: DataFrame, group: list[str], keys: Sequence[str], seed: int, resamples: int) -> DataFrame:
    """``(group.., replicate, value)``: rows of a group and key are added up first, and a key is drawn in one task, once for all
    groups; each task sends two sums for each group and replicate."""
    errors = known(df).select(*group, F.abs(F.col("y") - F.col("yhat")).cast("double").alias("_e"), poisson_key(*[F.col(k) for k in keys]).alias("_key"))
    rows = by_key(errors.groupBy(*group, "_key").agg(F.sum("_e").alias("_e"), F.count("_e").alias("_n")), "_key")
    at = range(1, resamples + 1)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for piece, counts in with_counts(batches, "_key", seed, resamples):
            piece, counts = piece.reset_index(drop=True), counts.astype(float)
            parts = piece.groupby(group, dropna=False, sort=False) if group else [((), piece)]
            for key, part in parts:
                both = part[["_e", "_n"]].to_numpy(float).T @ counts[part.index]
                sums[key] = sums[key] + both if key in sums else both
        for key, (total_, n) in sums.items():
            named = {g: pd.Series([None if pd.isna(v) else v] * resamples, dtype=object) for g, v in zip(group, key, strict=True)}
            yield pd.DataFrame({**named, "replicate": at, "_s": total_, "_n": n})

    out = T.StructType([rows.schema[g] for g in group] + [T.StructField("replicate", T.LongType()), T.StructField("_s", T.DoubleType()), T.StructField("_n", T.DoubleType())])
    whole = rows.mapInPandas(partial, out).groupBy(*group, "replicate").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return whole.where("_n > 0").select(*group, "replicate", (F.col("_s") / F.col("_n")).alias("value"))


def standardised(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Columns to mean 0 and sd 1 (ddof 0); a constant column becomes 0."""
    stats = {f"_m_{c}": F.avg(c) for c in columns} | {f"_s_{c}": F.stddev_pop(c) for c in columns}
    out = with_stats(df, by, stats)
    return out.withColumns(
        {
            c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, lit(1)).otherwise(F.col(f"_s_{c}"))
            for c in columns
        }
    ).select(*df.columns)


def payload_checks(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row: rows, missing and non-finite values per column, duplicate keys."""
    d = {c: F.col(c).cast("double") for c in columns}
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggs += [
            F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_missing"),
            F.sum((F.isnan(d[c]) | (F.abs(d[c]) == float("inf"))).cast("long")).alias(f"{c}_not_finite"),
        ]
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("n")
    )
    return df.agg(*aggs).withColumn("duplicate_keys", dup.scalar())


def best_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return top_n(df, group, order, n)
