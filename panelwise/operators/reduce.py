"""Feature reduction from sums of products: one pass over the rows, p x p work on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelwise.functions.guards import lit
from panelwise.operators.linear import covariance, linear_expression, moments
from panelwise.operators.ordered import group_quantiles
from panelwise.operators.passes import with_stats
from panelwise.panel import to_long
from panelwise.session import settle


def keep_varying(df: DataFrame, columns: Sequence[str], threshold: float = 0.005) -> list[str]:
    """Columns whose variance (ddof 0) is above the threshold."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] > threshold]


def variances(df: DataFrame, columns: Sequence[str], threshold: float = 0.005) -> DataFrame:
    """``(feature, variance, kept)``."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in columns])
    return row.select(F.inline(cells)).withColumn("kept", F.coalesce(F.col("variance") > threshold, F.lit(False)))


def keep_distinct(df: DataFrame, columns: Sequence[str], twin: float = 0.98, max_vif: float = 10.0, batch: int = 5) -> list[str]:
    """Drop the later one of each near-identical pair, then the worst variance inflation
    factors, a few at a time, until all are at most ``max_vif``."""
    _, cov, n = covariance(moments(df, columns))
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    r = cov / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1.0)
    np.fill_diagonal(r, 1.0)
    kept: list[int] = []
    for j in range(len(columns)):
        if sd[j] > 0 and all(abs(r[i, j]) <= twin for i in kept):
            kept.append(j)
    while len(kept) > 2:
        vif = np.diag(np.linalg.pinv(r[np.ix_(kept, kept)]))
        bad = [kept[i] for i in np.argsort(-vif) if vif[i] > max_vif][:batch]
        if not bad:
            break
        kept = [k for k in kept if k not in bad]
    return [columns[k] for k in kept]


def principal_components(
    df: DataFrame, columns: Sequence[str], share: float = 0.95, limit: int = 60
) -> tuple[np.ndarray, list[str]]:
    """Loadings (p x k) of the standardised columns: enough components for ``share`` of the
    variance, at most ``limit`` and n / 5."""
    _, cov, n = covariance(moments(df, columns))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    part = np.cumsum(values) / max(values.sum(), 1e-300)
    k = int(min(np.searchsorted(part, share) + 1, limit, max(1, n // 5), len(columns)))
    signs = np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(columns))] < 0, -1.0, 1.0)
    return (vectors * signs)[:, :k], [f"pc{i + 1}" for i in range(k)]


def partial_least_squares(df: DataFrame, x: Sequence[str], y: Sequence[str], k: int | None = None) -> np.ndarray:
    """Weights (p x k) that project standardised x on directions of largest covariance with
    y; everything from X'X and X'Y, deflated on the driver."""
    _, cov, n = covariance(moments(df, [*x, *y]))
    p = len(x)
    xx, xy = cov[:p, :p], cov[:p, p:].copy()
    k = k or int(max(1, min(n // 10, 20, p)))
    weights, loads = [], []
    for _ in range(k):
        u, s, _ = np.linalg.svd(xy, full_matrices=False)
        if s[0] < 1e-12:
            break
        r = u[:, 0]
        t2 = r @ xx @ r
        if t2 < 1e-12:
            break
        r = r / np.sqrt(t2)
        load = xx @ r
        basis = load.copy()
        for v in loads:
            basis -= v * (v @ basis)
        norm = np.linalg.norm(basis)
        if norm < 1e-12:
            break
        loads.append(basis / norm)
        xy -= np.outer(loads[-1], loads[-1] @ xy)
        weights.append(r)
    return np.array(weights).T if weights else np.zeros((p, 0))


def project(df: DataFrame, columns: Sequence[str], loadings: np.ndarray, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The projection as column expressions."""
    return df.select(
        *keep, *[linear_expression(columns, 0.0, loadings[:, i]).alias(n) for i, n in enumerate(names)]
    )


def back_to_features(loadings: np.ndarray, importance: Sequence[float], columns: Sequence[str]) -> dict[str, float]:
    """Component importances spread over the original columns by absolute loading."""
    raw = np.abs(loadings) @ np.asarray(importance, dtype=float)
    whole = raw.sum()
    return {c: float(v / whole) if whole > 0 else 0.0 for c, v in zip(columns, raw)}


def _codes(rows: DataFrame, bins: int, key: str, out: str) -> DataFrame:
    """Quantile-bin number of each value inside its key."""
    levels = {f"q{i}": i / bins for i in range(1, bins)}
    edges = settle(group_quantiles(rows, [key], "value", levels))
    placed = rows.join(edges, key)
    return placed.withColumn(out, sum((F.col("value") > F.col(q)).cast("int") for q in levels)).drop("value", "n", *levels)


def mutual_information(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str], bins: int = 8
) -> DataFrame:
    """``(feature, target, mi)`` on quantile bins: joint counts, one grouped sum.

    Each row meets its own targets only (features x targets rows, both schema)."""
    f = to_long(df, features, keep_missing=False, ids=keys).withColumn("value", F.round("value", 9))
    t = to_long(df, targets, keep_missing=False, ids=keys).withColumn("value", F.round("value", 9))
    a = _codes(settle(f).withColumnRenamed("indicator", "feature"), bins, "feature", "_a")
    b = _codes(settle(t).withColumnRenamed("indicator", "target"), bins, "target", "_b")
    joint = settle(a.join(b, list(keys)).groupBy("feature", "target", "_a", "_b").agg(F.count(F.lit(1)).cast("double").alias("_n")))
    pair = ["feature", "target"]
    total_n = joint.groupBy(*pair).agg(F.sum("_n").alias("_t"))
    na = joint.groupBy(*pair, "_a").agg(F.sum("_n").alias("_na"))
    nb = joint.groupBy(*pair, "_b").agg(F.sum("_n").alias("_nb"))
    full = joint.join(total_n, pair).join(na, [*pair, "_a"]).join(nb, [*pair, "_b"])
    p = F.col("_n") / F.col("_t")
    return full.groupBy(*pair).agg(F.sum(p * F.log(F.col("_n") * F.col("_t") / (F.col("_na") * F.col("_nb")))).alias("mi"))


def informative(mi: DataFrame, k: int) -> DataFrame:
    """Union over the targets of the k most informative features."""
    from pyspark.sql import Window

    w = Window.partitionBy("target").orderBy(F.round("mi", 9).desc(), F.col("feature"))
    return mi.withColumn("_p", F.row_number().over(w)).where(F.col("_p") <= k).select("feature").distinct()


def standardise(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, Mapping[str, tuple[float, float]]]:
    """Columns to mean 0, sd 1 (ddof 0), and the fitted means and sds (schema-sized)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    fit = {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}
    return df.withColumns({c: (F.col(c) - fit[c][0]) / lit(fit[c][1]) for c in columns}), fit


def apply_standardise(df: DataFrame, fit: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / lit(s) for c, (m, s) in fit.items()})


def effective_outputs(df: DataFrame, columns: Sequence[str], share: float = 0.90) -> int:
    """Eigenvalues of the pairwise-complete correlation matrix needed for ``share`` of the
    variance: the divisor of a Bonferroni correction over correlated outputs."""
    aggs = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
            aggs.append(F.try_divide(F.covar_samp(a, b), F.stddev_samp(x) * F.stddev_samp(y)).alias(f"{a}|{b}"))
    if not aggs:
        return 1
    row = df.agg(*aggs).first()
    r = np.eye(len(columns))
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            r[i, j] = r[j, i] = row[f"{a}|{columns[j]}"] or 0.0
    values = np.maximum(np.sort(np.linalg.eigvalsh(r))[::-1], 0.0)
    return int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12) + 1)


def center_by(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    out = with_stats(df, by, {f"_m_{c}": F.avg(c) for c in columns})
    return out.withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in columns}).select(*df.columns)
