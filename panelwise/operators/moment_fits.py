"""Fits that need only sums of products: penalty paths over all folds, joint sparsity over outputs, refits without an entity.

The rows are read once for each of them, into one matrix of sums for each period (or one in all); every fold, setting and
penalty then costs work on matrices of the schema's size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from panelwise.functions.guards import lit
from panelwise.operators.linear import covariance, linear_expression, moment_rows, moments
from panelwise.operators.splits import fold_table
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle


def standardised(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """``df`` with the columns about their mean, in standard deviations (1 for a flat column), and both; sums of products of such
    columns keep their digits."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(columns)]).first()
    mean = np.array([row[f"m_{i}"] or 0.0 for i in range(len(columns))])
    sd = np.array([row[f"s_{i}"] or 1.0 for i in range(len(columns))])
    return df.withColumns({c: (F.col(c) - float(m)) / lit(float(s)) for c, m, s in zip(columns, mean, sd, strict=True)}), mean, sd


def moments_by(df: DataFrame, columns: Sequence[str], key: str) -> dict:
    """One matrix of sums of products for each value of ``key`` (periods, imputations: few)."""
    out: dict = {}
    p = len(columns) + 1
    for r in moment_rows(df, columns, [key]).collect():
        m = out.setdefault(r[key], np.zeros((p, p)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    return out


def descend(gram: np.ndarray, target: np.ndarray, l1: float, l2: float, start: np.ndarray, rounds: int = 1_000, tolerance: float = 1e-7) -> np.ndarray:
    """Coordinate descent on b'Gb / 2 - b't + l1 |b| + l2 |b|^2 / 2."""
    b = start.copy()
    gradient = target - gram @ b
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(b)):
            if gram[j, j] <= 0:
                continue
            rho = gradient[j] + gram[j, j] * b[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (gram[j, j] + l2)
            if new != b[j]:
                gradient -= gram[:, j] * (new - b[j])
                moved, b[j] = max(moved, abs(new - b[j])), new
        if moved < tolerance:
            break
    return b


def _path(m: np.ndarray, penalties: Sequence[float], l1: float) -> list[tuple[float, np.ndarray]]:
    """(intercept, slopes) of the last column on the others for falling penalties, each fit started from the one before.

    Columns are scaled by their standard deviations and the penalty by the target's, as Spark's own elastic net does."""
    mean, cov, _ = covariance(m)
    p = len(mean) - 1
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    scale = np.where(sd > 1e-12, sd, 1.0)
    flat = sd <= 1e-12
    gram, target = cov[:p, :p] / np.outer(scale[:p], scale[:p]), cov[:p, p] / (scale[:p] * scale[p])
    gram[flat[:p]], gram[:, flat[:p]], target[flat[:p]] = 0.0, 0.0, 0.0
    b, out = np.zeros(p), []
    for penalty in penalties:
        if not flat[p]:
            b = descend(gram, target, l1 * penalty / scale[p], (1 - l1) * penalty / scale[p], b)
        slopes = b * scale[p] / scale[:p]
        out.append((float(mean[p] - mean[:p] @ slopes), slopes))
    return out


def penalty_grid(
    df: DataFrame, x: Sequence[str], y: str, penalties: Sequence[float] = (0.001, 0.01, 0.1), l1_ratios: Sequence[float] = (0.1, 0.5, 0.9),
    min_train: int = 3, max_folds: int = 3, period: str = PERIOD,
) -> DataFrame:
    """``(setting, penalty, l1, fold, val_period, n, r2, rmse)``: every setting of an elastic net on every walk-forward fold.

    One pass: sums of products by period. A fold's training sums are the running sums of the periods before; its validation
    error follows from the validation period's sums; each l1 share's path runs from the largest penalty down. Rows
    without the target or a feature are left out; a fold without rows on either side has no row."""
    columns = [*x, y]
    scaled, mean, sd = standardised(df.where(F.col(y).isNotNull()).select(period, *columns), columns)
    by = moments_by(scaled, columns, period)
    p = len(columns) + 1
    settings = list(product(penalties, l1_ratios))
    rows = []
    for f in fold_table(df.where(F.col(y).isNotNull()), period, min_train, max_folds).orderBy("fold").collect():
        train = sum((m for k, m in by.items() if k < f["val_period"]), np.zeros((p, p)))
        held = by.get(f["val_period"], np.zeros((p, p)))
        if not train[0, 0] or not held[0, 0]:
            continue
        for l1 in l1_ratios:
            falling = sorted(penalties, reverse=True)
            for penalty, (intercept, slopes) in zip(falling, _path(train, [v / sd[-1] for v in falling], l1), strict=True):
                line = np.concatenate([[-intercept], -slopes, [1.0]])  # residual of (1, x, y)
                rss = max(float(line @ held @ line), 0.0)
                spread = max(float(held[-1, -1] - held[0, -1] ** 2 / held[0, 0]), 0.0)
                tiny = 1e-12 / sd[-1] ** 2
                r2 = 1 - rss / spread if spread >= tiny else float(rss < tiny)
                rows.append((settings.index((penalty, l1)), penalty, l1, f["fold"], f["val_period"], int(held[0, 0]), r2, float(np.sqrt(rss / held[0, 0]) * sd[-1])))
    return df.sparkSession.createDataFrame(rows, "setting int, penalty double, l1 double, fold int, val_period int, n long, r2 double, rmse double")


def joint_descent(gram: np.ndarray, target: np.ndarray, l21: float, l2: float, rounds: int = 5_000, tolerance: float = 1e-10) -> np.ndarray:
    """Block coordinate descent on tr(B'GB) / 2 - tr(B'T) + l21 * (sum of the rows' norms) + l2 |B|^2 / 2."""
    b = np.zeros_like(target)
    gradient = target.copy()
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(b)):
            if gram[j, j] <= 0:
                continue
            rho = gradient[j] + gram[j, j] * b[j]
            norm = np.linalg.norm(rho)
            new = max(1 - l21 / norm, 0.0) * rho / (gram[j, j] + l2) if norm > 0 else np.zeros_like(rho)
            step = new - b[j]
            if step.any():
                gradient -= np.outer(gram[:, j], step)
                moved, b[j] = max(moved, np.abs(step).max()), new
        if moved < tolerance:
            break
    return b


def multi_task_elastic_net(df: DataFrame, x: Sequence[str], targets: Sequence[str], penalty: float = 0.01, l1: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(predictions, coefficients): one linear model for all targets that keeps or drops a feature for all of them at once.

    A row counts by the share of its targets that are present, the missing ones standing at their mean; rows without any
    target teach nothing. Columns are standardised. ``predictions``: all rows of ``df`` with ``yhat_<target>``, null where a feature
    is missing. ``coefficients``: ``(target, feature, coefficient, sigma)`` in the columns' units, ``sigma`` the root of the mean squared weighted residual."""
    columns = [*x, *targets]
    scaled, mean, sd = standardised(df, columns)
    share = sum((F.col(t).isNotNull().cast("double") for t in targets), lit(0)) / lit(len(targets))
    rows = scaled.withColumn("_w", share).where("_w > 0").withColumns({t: F.coalesce(t, lit(0)) for t in targets})
    centre, cov, n = covariance(moments(rows, columns, "_w"))
    p = len(x)
    b = joint_descent(cov[:p, :p], cov[:p, p:], l1 * penalty, (1 - l1) * penalty)
    loss = np.diag(cov[p:, p:] - 2 * b.T @ cov[:p, p:] + b.T @ cov[:p, :p] @ b)
    lines, table = {}, []
    for k, t in enumerate(targets):
        slopes = b[:, k] * sd[p + k] / sd[:p]
        intercept = mean[p + k] + sd[p + k] * (centre[p + k] - centre[:p] @ b[:, k]) - mean[:p] @ slopes
        lines[f"yhat_{t}"] = linear_expression(x, float(intercept), slopes)
        sigma = float(np.sqrt(max(loss[k], 0.0)) * sd[p + k])
        table += [(t, name, float(v), sigma) for name, v in zip(["(intercept)", *x], [intercept, *slopes], strict=True)]
    return df.withColumns(lines), df.sparkSession.createDataFrame(table, "target string, feature string, coefficient double, sigma double")


def leave_one_entity_out(df: DataFrame, x: Sequence[str], y: str, penalty: float = 1.0) -> DataFrame:
    """``(entity, period, y, yhat)``: each row predicted by a ridge fit on the rows of all OTHER entities.

    The sums of products of all rows less those of the entity's own are the sums that a refit would see, so each entity is
    solved where its rows (one a period) meet; nothing is read again. ``penalty`` is added to the sums of the standardised
    features. Rows without the target or a feature are left out; a single entity has no others and no prediction."""
    columns = [*x, y]
    known = df.select(ENTITY, PERIOD, *columns).dropna(subset=columns)
    scaled, mean, sd = standardised(known, columns)
    whole, p = moments(scaled, columns), len(x)
    met = scaled.groupBy(ENTITY).agg(F.collect_list(F.struct(PERIOD, F.array(*columns).alias("v"))).alias("rows"))
    schema = T.StructType([df.schema[ENTITY], df.schema[PERIOD], T.StructField("y", T.DoubleType()), T.StructField("yhat", T.DoubleType())])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for entity, rows in zip(pdf[ENTITY], pdf["rows"], strict=True):
                v = np.array([r["v"] for r in rows], float)
                own = np.column_stack([np.ones(len(v)), v])
                centre, cov, n = covariance(whole - own.T @ own)
                yhat = np.full(len(v), np.nan)
                if n > 0.5:
                    beta = np.linalg.solve(cov[:p, :p] * n + penalty * np.eye(p), cov[:p, p] * n)
                    yhat = centre[p] + (v[:, :p] - centre[:p]) @ beta
                yield pd.DataFrame({ENTITY: entity, PERIOD: [r[PERIOD] for r in rows], "y": v[:, p] * sd[p] + mean[p], "yhat": yhat * sd[p] + mean[p]})

    out = met.mapInPandas(solve, schema)
    return settle(out.withColumn("yhat", F.when(~F.isnan("yhat"), F.col("yhat"))))
