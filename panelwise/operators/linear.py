"""Sums of products of columns, the one pass behind every linear fit here."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


#: Sums that a task keeps before it hands them on: 16 MB.
HELD = 2_000_000


def moment_rows(
    df: DataFrame, columns: Sequence[str], group: Sequence[str] = (), weight: str | None = None,
    lift: Callable[[np.ndarray], np.ndarray] | None = None, n_lifted: int = 0, n_out: int = 0,
) -> DataFrame:
    """``(group.., i, j, s)``: sums of x_i * x_j, with x_0 = 1, over complete rows.

    ``lift`` replaces the first ``n_lifted`` columns by ``n_out`` derived ones inside the task.

    Each task adds up its own Arrow batches (p x p numbers per group seen), then the
    partial sums meet in one small shuffle."""
    columns, group = list(columns), list(group)
    extra = [weight] if weight else []
    rows = df.select(*group, *columns, *extra)
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    keys = [f for f in rows.schema.fields if f.name in group]
    p = len(columns) - n_lifted + n_out + 1
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def written(sums: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
        for key, m in sums.items():
            out = pd.DataFrame({"i": [a for a, _ in pairs], "j": [b for _, b in pairs], "s": [m[a, b] for a, b in pairs]})
            for name, value in zip(group, key):
                out[name] = value
            yield out[[*group, "i", "j", "s"]]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            parts = pdf.groupby(group, sort=False) if group else [((), pdf)]
            for key, part in parts:
                x = part[columns].to_numpy(float)
                if lift is not None:
                    x = np.column_stack([lift(x[:, :n_lifted]), x[:, n_lifted:]])
                x = np.column_stack([np.ones(len(part)), x])
                w = part[weight].to_numpy(float)[:, None] if weight else 1.0
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0.0) + x.T @ (w * x)
            if len(sums) * p * p > HELD:  # very many groups: what is summed so far goes on to the shuffle
                yield from written(sums)
                sums = {}
        yield from written(sums)

    schema = T.StructType(
        [*keys, T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("s", T.DoubleType())]
    )
    return rows.mapInPandas(partial, schema).groupBy(*group, "i", "j").agg(F.sum("s").alias("s"))


def moments(df: DataFrame, columns: Sequence[str], weight: str | None = None, **lifting) -> np.ndarray:
    """The (p+1) x (p+1) matrix of one group; its size is the schema's, not the data's."""
    p = len(columns) - lifting.get("n_lifted", 0) + lifting.get("n_out", 0) + 1
    m = np.zeros((p, p))
    for row in moment_rows(df, columns, (), weight, **lifting).collect():
        m[row["i"], row["j"]] = m[row["j"], row["i"]] = row["s"]
    return m


def covariance(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Means, covariance (ddof 0) and row count from a moment matrix."""
    n = m[0, 0]
    if n == 0:
        return np.zeros(len(m) - 1), np.zeros((len(m) - 1, len(m) - 1)), 0.0
    mean = m[0, 1:] / n
    return mean, m[1:, 1:] / n - np.outer(mean, mean), n


def solve_ridge(m: np.ndarray, x: Sequence[int], y: int, penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and slopes of column y on columns x (0-based), ridge on the slopes."""
    mean, cov, n = covariance(m)
    x = list(x)
    if n == 0 or not x:
        return (mean[y] if n else 0.0), np.zeros(len(x))
    a = cov[np.ix_(x, x)] + penalty * np.eye(len(x))
    beta = np.linalg.solve(a, cov[x, y])
    return float(mean[y] - mean[x] @ beta), beta


def linear_expression(columns: Sequence[str], intercept: float, beta: Sequence[float]) -> Column:
    """The fitted line as one SQL expression, so that scoring stays in the JVM."""
    terms = [f"{float(intercept)!r}D", *[f"{float(b)!r}D * `{c}`" for c, b in zip(columns, beta)]]
    return F.expr(" + ".join(terms))
