"""Adaptive and small-sample interval widths."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from panelwise.functions.guards import lit
from panelwise.functions.relative_cells import ERROR, cell_of, upper_end
from panelwise.functions.special import t_quantile
from panelwise.operators.evaluate import known
from panelwise.operators.intervals import level, residuals
from panelwise.operators.ordered import group_quantiles
from panelwise.panel import PERIOD
from panelwise.session import settle


def residual_histogram(df: DataFrame, group: Sequence[str], error: float = ERROR) -> DataFrame:
    """``(group.., period, cell, n)``: absolute residuals counted in cells of a relative width, so that
    their scale does not matter. Every later step sees periods x cells that occur, however many forecasts there are."""
    size = F.abs(F.col("y") - F.col("yhat"))
    return known(df).groupBy(*group, PERIOD, cell_of(size, error).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def rank_of(alpha: float, n: float) -> float:
    """Place of the conformal quantile among n sorted residuals."""
    return min(math.ceil(round((1 - alpha) * (n + 1), 9)), n)


def moved(alpha_t: float, miss: float, alpha: float, gamma: float) -> float:
    """The level after a period in which the share ``miss`` lay outside."""
    return min(max(alpha_t + gamma * (alpha - miss), 0.001), 0.999)


def adaptive_widths(
    df: DataFrame, group: Sequence[str], alpha: float = 0.1, gamma: float = 0.05, error: float = ERROR
) -> DataFrame:
    """``(group.., period, alpha_t, half_width, miss)`` for every period after the first.

    Before a period the half-width is the conformal quantile of all earlier residuals
    at level alpha_t, larger by the part ``error`` at most; then alpha_t moves by
    gamma (alpha - share missed). The recursion runs over periods, on counts of the cells that occur."""
    hist = residual_histogram(df, group, error).withColumn("end", upper_end(F.col("cell"), error))
    fields = [f for f in hist.schema.fields if f.name in group or f.name == PERIOD]
    schema = T.StructType(
        [*fields, *[T.StructField(n, T.DoubleType()) for n in ("alpha_t", "half_width", "miss")]]
    )

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, first, slots = np.unique(pdf["cell"].to_numpy(), return_index=True, return_inverse=True)
        ends, seen = pdf["end"].to_numpy(float)[first], np.zeros(len(cells))
        parts = pdf.assign(slot=slots).groupby(PERIOD)
        a, out = alpha, []
        for period, part in sorted(parts, key=lambda kv: kv[0]):
            mine, counts = part["slot"].to_numpy(int), part["n"].to_numpy(float)
            n = seen.sum()
            if n > 0:
                at = int(np.searchsorted(np.cumsum(seen), rank_of(a, n) - 1e-9))
                miss = counts[mine > at].sum() / counts.sum()
                out.append((period, a, ends[at], miss))
                a = moved(a, miss, alpha, gamma)
            np.add.at(seen, mine, counts)
        rows = pd.DataFrame(out, columns=[PERIOD, "alpha_t", "half_width", "miss"])
        for name in group:
            rows[name] = pdf[name].iloc[0]
        return rows[[f.name for f in schema.fields]]

    return hist.groupBy(*group).applyInPandas(walk, schema)


@pandas_udf(T.DoubleType())
def _t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) if b == b else None for a, b in zip(p, df)])


def student_widths(df: DataFrame, group: Sequence[str], alpha: float = 0.1, small: int = 100) -> DataFrame:
    """``(group.., n, half_width)``: groups of at most ``small`` rows use the quantile of a
    Student t fitted to the absolute residuals (location 0, one degree of freedom less
    than fitted); larger groups the conformal quantile.

    The fit is a likelihood grid over degrees of freedom and scale, refined once; only
    the small groups are multiplied by the grid."""
    rows = settle(residuals(df).select(*group, "abs_residual"))
    plain = settle(group_quantiles(rows, group, "abs_residual", {"_plain": level(alpha)}))
    few = plain.where(F.col("n") <= small)
    mine = rows.join(few.select(*group), list(group), "left_semi")
    size = settle(mine.groupBy(*group).agg(F.sqrt(F.avg(F.col("abs_residual") * F.col("abs_residual"))).alias("_rms")))
    best = _likelihood(mine.join(size, list(group)), group, [1, 2, 3, 4, 5, 7, 10, 15, 20, 30, 50, 100], F.col("_rms"), [2 ** (i / 2 - 4) for i in range(11)])
    near = mine.join(settle(best), list(group))
    fine = _refine(near, group)
    dof = F.greatest(F.col("df") - 1, lit(1))
    student = fine.select(*group, (_t_quantile(lit(1 - alpha), dof) * F.col("scale")).alias("_t"))
    out = plain.join(settle(student), list(group), "left")
    return out.select(*group, "n", F.coalesce("_t", "_plain").alias("half_width"))


def _log_density(r: Column, df: Column, scale: Column) -> Column:
    """Log density of a Student t up to terms without r are kept, as df and scale vary."""
    z = r / scale
    return -F.log(scale) - (df + 1) / 2 * F.log1p(z * z / df)


def _norm(df: float) -> float:
    return math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)


def _likelihood(rows: DataFrame, group: Sequence[str], dofs: Sequence[float], base: Column, steps: Sequence[float]) -> DataFrame:
    grid = F.array(
        *[F.struct(lit(d).alias("df"), lit(_norm(d)).alias("c"), lit(s).alias("m")) for d in dofs for s in steps]
    )
    cells = rows.withColumn("_base", F.greatest(base, lit(1e-12))).select(*group, "abs_residual", "_base", F.inline(grid))
    scale = F.col("_base") * F.col("m")
    like = cells.groupBy(*group, "df", "m").agg(
        F.sum(F.col("c") + _log_density(F.col("abs_residual"), F.col("df"), scale)).alias("ll"), F.first(scale).alias("scale")
    )
    top = F.max_by(F.struct("df", "scale"), F.struct(F.round("ll", 9), -F.col("df")))
    return like.groupBy(*group).agg(top.alias("_b")).select(*group, "_b.*")


def _refine(near: DataFrame, group: Sequence[str]) -> DataFrame:
    """A finer grid of scales around the best cell, its degrees of freedom kept."""
    steps = F.array(*[lit(2 ** (i / 16 - 0.5)) for i in range(17)])
    cells = near.select(*group, "abs_residual", "df", "scale", F.explode(steps).alias("m"))
    scale = F.col("scale") * F.col("m")
    like = cells.groupBy(*group, "df", "m").agg(
        F.sum(_log_density(F.col("abs_residual"), F.col("df"), scale)).alias("ll"), F.first(scale).alias("scale")
    )
    top = F.max_by(F.struct("df", "scale"), F.struct(F.round("ll", 9), -F.col("m")))
    return like.groupBy(*group).agg(top.alias("_b")).select(*group, "_b.*")
