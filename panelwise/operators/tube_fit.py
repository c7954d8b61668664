"""Regression with the epsilon-insensitive loss on random Fourier features of a Gaussian kernel."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from panelwise.functions.fourier import frequencies, waves
from panelwise.operators.moment_fits import standardised
from panelwise.session import settle

#: Distances from the tube's edge are taken as this large at least (in standard deviations of the target).
EDGE = 1e-4


def bounding(r: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight, centre) of the parabola weight * (r - centre)^2, up to a constant, that touches max(|r| - epsilon, 0) at
    ``r`` and lies above it elsewhere: for each side u of the tube max(u, 0) <= (u + |u0|)^2 / (4 |u0|)."""
    high, low = np.maximum(np.abs(r - epsilon), EDGE), np.maximum(np.abs(r + epsilon), EDGE)
    w, v = 1 / (4 * high), 1 / (4 * low)
    return w + v, (w * (epsilon - high) + v * (low - epsilon)) / (w + v)


def epsilon_insensitive(
    df: DataFrame, x: Sequence[str], targets: Sequence[str], cost: float = 1.0, epsilon: float = 0.1, bandwidth: float | None = None,
    number: int = 20, rounds: int = 200, tolerance: float = 1e-4, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """(predictions, fits): for each target f minimises |w|^2 / 2 + ``cost`` * sum of max(|y - f| - ``epsilon``, 0).

    Features and targets are standardised; f is linear in 2 ``number`` random Fourier features (``bandwidth``: the root of
    half the number of columns if not given) and a constant. Each round replaces the loss by parabolas that lie above it
    (:func:`bounding`), whose minimum needs sums of products only: one pass over the rows for all targets, and the objective falls
    in every round. A target is done once a round lowers its objective by no more than ``tolerance`` of it.

    ``predictions``: all rows with ``yhat_<target>``, null where a feature is missing. ``fits``: ``(target, n, objective, rounds,
    last_change)``, the objective in standardised units. Rows without a feature teach nothing, nor do rows without the target teach
    it; a target without rows is predicted by null."""
    x, targets = list(x), list(targets)
    scaled, mean, sd = standardised(df.select(*x, *targets).dropna(subset=x), [*x, *targets])
    rows = settle(scaled)
    p, k = len(x), len(targets)
    omega = frequencies(p, number, bandwidth or np.sqrt(p / 2), seed)
    d = 2 * number + 1
    upper = np.triu_indices(d)
    ridge = np.eye(d)
    ridge[0, 0] = 1e-9  # the constant is free

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(v)), waves(v, omega)])

    def passed(b: np.ndarray, open_: list[int]) -> dict[int, np.ndarray]:
        """By target: upper half of Z'WZ, Z'Wt, loss, rows."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = {j: np.zeros(len(upper[0]) + d + 2) for j in open_}
            for pdf in batches:
                z = lifted(pdf[x].to_numpy(float))
                for j in open_:
                    y = pdf[targets[j]].to_numpy(float)
                    has = ~np.isnan(y)
                    a, r = z[has], y[has] - z[has] @ b[:, j]
                    weight, centre = bounding(r, epsilon)
                    m = a.T @ (weight[:, None] * a)
                    loss = np.maximum(np.abs(r) - epsilon, 0.0).sum()
                    sums[j] += np.concatenate([m[upper], a.T @ (weight * (y[has] - centre)), [loss, has.sum()]])
            for j, s in sums.items():
                yield pd.DataFrame({"j": np.int32(j), "i": np.arange(len(s), dtype=np.int32), "s": s})

        out = {j: np.zeros(len(upper[0]) + d + 2) for j in open_}
        for r in rows.mapInPandas(add, "j int, i int, s double").groupBy("j", "i").agg(F.sum("s").alias("s")).collect():
            out[r["j"]][r["i"]] = r["s"]
        return out

    b, before = np.zeros((d, k)), np.full(k, np.inf)
    best, done = np.zeros((d, k)), {}
    open_ = list(range(k))
    for i in range(rounds + 1):
        for j, s in passed(b, open_).items():
            n, objective = int(s[-1]), float(s[-2] * cost + b[1:, j] @ b[1:, j] / 2)
            change = before[j] - objective
            if objective <= before[j]:
                best[:, j], before[j] = b[:, j], objective
            if not n or i == rounds or change <= tolerance * abs(objective):
                done[j] = (targets[j], n, float(before[j]), i, float(change) if np.isfinite(change) else None)
                continue
            m = np.zeros((d, d))
            m[upper] = s[: len(upper[0])]
            m = m + m.T - np.diag(np.diag(m))
            b[:, j] = np.linalg.solve(2 * cost * m + ridge, 2 * cost * s[len(upper[0]) : -2])
        open_ = [j for j in open_ if j not in done]
        if not open_:
            break
    empty = {j for j, f in done.items() if not f[1]}

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(*cols: pd.Series) -> pd.Series:
        v = (np.column_stack([c.to_numpy(float) for c in cols]) - mean[:p]) / sd[:p]
        out = np.full((len(v), k), np.nan)
        whole = ~np.isnan(v).any(axis=1)
        out[whole] = lifted(v[whole]) @ best * sd[p:] + mean[p:]
        return pd.Series(list(out))

    scored = df.withColumn("_yhat", score(*[F.col(c).cast("double") for c in x]))
    value = lambda j: F.lit(None).cast("double") if j in empty else F.when(~F.isnan(F.col("_yhat")[j]), F.col("_yhat")[j])
    predictions = scored.withColumns({f"yhat_{t}": value(j) for j, t in enumerate(targets)}).drop("_yhat")
    schema = "target string, n long, objective double, rounds int, last_change double"
    return predictions, df.sparkSession.createDataFrame([done[j] for j in range(k)], schema)
