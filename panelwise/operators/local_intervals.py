"""Conformal widths weighted by nearness of the features, without comparing queries with calibration rows.

The weight of all calibration rows in a cell of residuals is, for any query, the product of the query's random Fourier
features with the cell's sum of them. So rows are read once into a table of cells x features, and a query's weighted
distribution of residuals costs one product with it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from panelwise.functions.fourier import frequencies, waves
from panelwise.operators.intervals import residuals
from panelwise.operators.moment_fits import standardised
from panelwise.operators.ordered import group_quantiles
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle

#: Calibration rows of a group whose distances give the bandwidth (their median).
DISTANCE_ROWS = 500


def bandwidths(rows: DataFrame, x: Sequence[str], least: float = 1e-6) -> dict[int, float]:
    """Median distance between ``DISTANCE_ROWS`` rows of each group (``_g``), drawn by a hash of entity and period; equal rows do not count."""
    order = Window.partitionBy("_g").orderBy(F.xxhash64(ENTITY, PERIOD), ENTITY, PERIOD)
    drawn = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= DISTANCE_ROWS)
    out = {}
    for g, part in drawn.select("_g", *x).toPandas().groupby("_g"):
        v = part[list(x)].to_numpy(float)
        far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))[np.triu_indices(len(v), 1)]
        far = far[far > 0]
        out[int(g)] = max(float(np.median(far)), least) if len(far) else 1.0
    return out


def locally_weighted(
    calibration: DataFrame, queries: DataFrame, x: Sequence[str], group: Sequence[str], alpha: float = 0.1,
    entity_weight: float = 2.0, cells: int = 64, number: int = 128, seed: int = 42,
) -> DataFrame:
    """``queries`` (columns group.., entity, period, ``yhat``, ``x``) with ``half_width``, ``lower`` and ``upper``.

    The half-width is the 1 - alpha quantile of the group's absolute residuals, each weighted by a Gaussian kernel of the
    (standardised) features, times ``entity_weight`` if it is of the query's own entity; infinity has the mass
    1 / (n + 1). Weights of the own entity's rows (one a period) are exact. The others have an error of about
    1 / sqrt(2 ``number``) of full weight, and widths are rounded up to the end of one of ``cells`` quantile cells. A query
    whose mean weight is below twice that error, so far from all rows, weighs all rows alike. Groups (models and
    components) are few: ``cells`` x 2 ``number`` numbers of each reach the driver.

    Rows without residual or a feature teach nothing. A query without a feature, or of a group with fewer
    than three rows, has null widths."""
    x, group = list(x), list(group)
    known = residuals(calibration).dropna(subset=x).select(*group, ENTITY, PERIOD, *x, "abs_residual")
    scaled, mean, sd = standardised(known, x)
    scaled = settle(scaled)
    levels = {f"q{i}": i / cells for i in range(1, cells + 1)}
    found = [r for r in group_quantiles(scaled, group, "abs_residual", levels).collect() if r["n"] >= 3]
    edges = [np.unique([r[q] for q in levels]) for r in found]
    schema = T.StructType([*[queries.schema[c] for c in group], T.StructField("_g", T.IntegerType())])
    numbers = settle(queries.sparkSession.createDataFrame([(*[r[c] for c in group], g) for g, r in enumerate(found)], schema))
    rows = settle(scaled.join(numbers, group))
    widths = bandwidths(rows, x)
    omega = {g: frequencies(len(x), number, h, seed) for g, h in widths.items()}

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for g, part in pdf.groupby("_g"):
                total = sums.setdefault(g, np.zeros((cells, 2 * number + 1)))
                v = np.column_stack([waves(part[x].to_numpy(float), omega[g]), np.ones(len(part))])
                np.add.at(total, np.searchsorted(edges[g], part["abs_residual"].to_numpy(float)), v)
        for g, total in sums.items():
            c, f = np.nonzero(total)
            yield pd.DataFrame({"g": np.int32(g), "c": c.astype(np.int32), "f": f.astype(np.int32), "s": total[c, f]})

    table = np.zeros((len(found), cells, 2 * number + 1))  # the last number of a cell counts its rows
    gathered = rows.select("_g", *x, "abs_residual").mapInPandas(gather, "g int, c int, f int, s double")
    for r in gathered.groupBy("g", "c", "f").agg(F.sum("s").alias("s")).collect():
        table[r["g"], r["c"], r["f"]] = r["s"]

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, part in pdf.groupby("_g", dropna=False):
                width = np.full(len(part), np.nan)
                if g == g:
                    g = int(g)
                    v = (part[x].to_numpy(float) - mean) / sd
                    whole = ~np.isnan(v).any(axis=1)
                    width[whole] = quantiles(v[whole], [o for o, w in zip(part["_own"], whole, strict=True) if w], g)
                yield part.drop(columns=["_g", "_own"]).assign(half_width=width)

    def quantiles(v: np.ndarray, own: list, g: int) -> np.ndarray:
        count = table[g, :, -1]
        n = count.sum()
        mass = waves(v, omega[g]) @ table[g, :, :-1].T
        near = mass.sum(axis=1) >= n * 2 / np.sqrt(2 * number)
        mass = np.where(near[:, None], np.maximum(mass, 0.0), count)
        for i in np.flatnonzero(near):
            for o in own[i] if own[i] is not None else []:
                kernel = np.exp(-((v[i] - np.array(o["x"], float)) ** 2).sum() / (2 * widths[g] ** 2))
                mass[i, np.searchsorted(edges[g], o["r"])] += (entity_weight - 1) * kernel
        reached = np.cumsum(mass, axis=1) / mass.sum(axis=1, keepdims=True) * n / (n + 1)
        place = (reached < 1 - alpha - 1e-12).sum(axis=1)
        ends = np.concatenate([edges[g], np.full(cells + 1 - len(edges[g]), np.inf)])
        return np.where(place < cells, ends[np.minimum(place, cells)], np.inf)

    own = settle(rows.groupBy("_g", ENTITY).agg(F.collect_list(F.struct(F.array(*x).alias("x"), F.col("abs_residual").alias("r"))).alias("_own")))
    asked = queries.select(*group, ENTITY, PERIOD, "yhat", *x).join(numbers, group, "left").join(own, ["_g", ENTITY], "left")
    names = [*group, ENTITY, PERIOD, "yhat", *x]
    schema = T.StructType([*[queries.schema[c] for c in names], T.StructField("half_width", T.DoubleType())])
    out = asked.select(*names, "_g", "_own").mapInPandas(widen, schema).withColumn("half_width", F.when(~F.isnan("half_width"), F.col("half_width")))
    return out.withColumns({"lower": F.col("yhat") - F.col("half_width"), "upper": F.col("yhat") + F.col("half_width")})
