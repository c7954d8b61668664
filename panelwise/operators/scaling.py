"""Scaling of matrix columns. Statistics are one aggregation per group; rows are
only projected."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwise.functions.guards import clip, lit, ratio, total
from panelwise.operators.passes import ONE_GROUP, attach, with_stats
from panelwise.session import settle

EPS = 1e-10


def _ends(columns: Sequence[str]) -> dict[str, Column]:
    return {f"_min_{c}": F.min(c) for c in columns} | {f"_max_{c}": F.max(c) for c in columns}


def fit_min_max(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), eps: float = EPS) -> DataFrame:
    """Statistics of the global scaler: ``low_*`` and ``span_*`` per group; an all-missing
    column gets low 0 and span eps."""
    base = df if by else df.withColumn(ONE_GROUP, F.lit(0))
    stats = base.groupBy(*(by or [ONE_GROUP])).agg(*[c.alias(n) for n, c in _ends(columns).items()])
    out = {}
    for c in columns:
        out[f"low_{c}"] = F.coalesce(F.col(f"_min_{c}"), lit(0))
        out[f"span_{c}"] = F.greatest(F.coalesce(F.col(f"_max_{c}") - F.col(f"_min_{c}"), lit(0)), lit(eps))
    return settle(stats.select(*(by or [ONE_GROUP]), *[v.alias(n) for n, v in out.items()]))


def apply_min_max(
    df: DataFrame, stats: DataFrame, columns: Sequence[str], by: Sequence[str] = (), inverse: bool = False
) -> DataFrame:
    """Transform rows, also new ones, with fitted statistics; or back."""
    base = df if by else df.withColumn(ONE_GROUP, F.lit(0))
    out = attach(base, stats, by or [ONE_GROUP])
    cols = {
        c: F.col(c) * F.col(f"span_{c}") + F.col(f"low_{c}")
        if inverse
        else (F.col(c) - F.col(f"low_{c}")) / F.col(f"span_{c}")
        for c in columns
    }
    return out.withColumns(cols).select(*df.columns)


def global_min_max(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), eps: float = EPS) -> DataFrame:
    return apply_min_max(df, fit_min_max(df, columns, by, eps), columns, by)


def ranking_min_max(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), cost: frozenset[str] = frozenset()
) -> DataFrame:
    """Min-max with cost columns inverted; a flat or empty column becomes 0.5."""
    out = with_stats(df, by, _ends(columns))
    cols = {}
    for c in columns:
        low, high = F.col(f"_min_{c}"), F.col(f"_max_{c}")
        up = (high - F.col(c)) if c in cost else (F.col(c) - low)
        cols[c] = F.when((high - low < 1e-12) | low.isNull(), lit(0.5)).otherwise(ratio(up, high - low))
    return out.withColumns(cols).select(*df.columns)


def normalize(
    df: DataFrame, columns: Sequence[str], kind: str, by: Sequence[str] = (), cost: frozenset[str] = frozenset()
) -> DataFrame:
    """``vector``, ``minmax``, ``max``, ``sum`` or ``abs_sum`` scaling of every column."""
    stats = _ends(columns)
    stats |= {f"_ss_{c}": F.sum(F.col(c) * F.col(c)) for c in columns}
    stats |= {f"_sum_{c}": F.sum(c) for c in columns} | {f"_n_{c}": F.count(c) for c in columns}
    stats |= {f"_inv_{c}": F.sum(1 / F.greatest(F.col(c), lit(1e-10))) for c in columns}
    out = with_stats(df, by, stats)

    def one(c: str) -> Column:
        x, low, high, s = F.col(c), F.col(f"_min_{c}"), F.col(f"_max_{c}"), F.col(f"_sum_{c}")
        if kind == "vector":
            n = F.sqrt(F.col(f"_ss_{c}"))
            return x / F.when(n == 0, lit(1)).otherwise(n)
        if kind == "minmax":
            span = F.when(high == low, lit(1)).otherwise(high - low)
            return ((high - x) if c in cost else (x - low)) / span
        if kind == "max":
            if c in cost:
                zero = F.when(high > 0, ratio(high - x, high)).otherwise(lit(0))
                return F.when(low > 0, ratio(low, x)).otherwise(zero)
            return x / F.when(high == 0, lit(1)).otherwise(high)
        if kind == "sum":
            if c in cost:
                return ratio(1 / F.greatest(x, lit(1e-10)), F.col(f"_inv_{c}"))
            return x / F.when(s == 0, lit(1)).otherwise(s)
        if kind == "abs_sum":
            return F.when(F.abs(s) > 0, ratio(x, F.abs(s))).otherwise(ratio(lit(1), F.col(f"_n_{c}")))
        raise ValueError(f"unknown scaling {kind!r}")

    return out.withColumns({c: one(c) for c in columns}).select(*df.columns)


def period_min_max(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Min-max per period, flat columns 0, clipped to [0, 1], missing kept."""
    out = with_stats(df, by, _ends(columns))
    cols = {}
    for c in columns:
        low, span = F.col(f"_min_{c}"), F.col(f"_max_{c}") - F.col(f"_min_{c}")
        scaled = F.when(span > 0, ratio(F.col(c) - low, span)).otherwise(lit(0))
        cols[c] = F.when(F.col(c).isNotNull(), clip(scaled, 0, 1))
    return out.withColumns(cols).select(*df.columns)


def distance_from_mean(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Euclidean distance of each row from the mean row of its group."""
    out = with_stats(df, by, {f"_avg_{c}": F.avg(c) for c in columns})
    gap = [F.pow(F.col(c) - F.col(f"_avg_{c}"), lit(2)) for c in columns]
    return out.withColumn("distance", F.sqrt(total(gap))).select(*df.columns, "distance")


def logit(x: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(x, lit(eps)), lit(1 - eps))
    return F.when(x.isNotNull(), F.log(p / (1 - p)))


def inverse_logit(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def yeo_johnson(x: Column, lam: float) -> Column:
    """Power transform defined on the whole line, for one lambda."""
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, lit(lam)) - 1) / lit(lam)
    two = 2 - lam
    down = -F.log1p(-x) if abs(two) < 1e-12 else -(F.pow(1 - x, lit(two)) - 1) / lit(two)
    return F.when(x >= 0, up).otherwise(down)


def inverse_yeo_johnson(z: Column, lam: float) -> Column:
    up = F.exp(z) - 1 if abs(lam) < 1e-12 else F.pow(z * lam + 1, lit(1 / lam)) - 1
    two = 2 - lam
    down = 1 - F.exp(-z) if abs(two) < 1e-12 else 1 - F.pow(1 - z * two, lit(1 / two))
    return F.when(z >= 0, up).otherwise(down)


def fit_yeo_johnson(df: DataFrame, column: str, low: float = -2.0, high: float = 4.0, rounds: int = 6) -> dict:
    """Lambda of the largest log-likelihood, with mean and sd of the transformed column.

    Each round is one aggregation that gives the likelihood of 13 candidates at
    once; the interval shrinks around the best."""
    x = F.col(column)
    logs = df.agg(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("s"), F.count(x).alias("n")).first()
    if not logs["n"]:
        return {"lambda": 1.0, "mean": 0.0, "sd": 1.0}
    best = 1.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / 12 for i in range(13)]
        row = df.agg(*[F.var_pop(yeo_johnson(x, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        score = [
            -math.inf if not row[f"v{i}"] or row[f"v{i}"] <= 0
            else -logs["n"] / 2 * math.log(row[f"v{i}"]) + (g - 1) * logs["s"]
            for i, g in enumerate(grid)
        ]
        best = grid[score.index(max(score))]
        step = (high - low) / 12
        low, high = best - step, best + step
    row = df.agg(F.avg(yeo_johnson(x, best)).alias("m"), F.stddev_pop(yeo_johnson(x, best)).alias("s")).first()
    return {"lambda": best, "mean": row["m"], "sd": row["s"] or 1.0}


def apply_yeo_johnson(x: Column, fitted: dict) -> Column:
    return (yeo_johnson(x, fitted["lambda"]) - fitted["mean"]) / lit(fitted["sd"])


def undo_yeo_johnson(z: Column, fitted: dict) -> Column:
    return inverse_yeo_johnson(z * fitted["sd"] + fitted["mean"], fitted["lambda"])
