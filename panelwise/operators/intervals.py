"""Conformal prediction intervals from residuals of earlier forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.guards import lit
from panelwise.operators.evaluate import known
from panelwise.operators.ordered import group_quantiles
from panelwise.operators.passes import attach
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle

GRID = 10


def level(alpha: float) -> Column:
    """min(ceil((1 - alpha)(n + 1)) / n, 1) as an expression over n."""
    n = F.col("n").cast("double")
    return F.least(F.ceil(F.round((1 - alpha) * (n + 1), 9)).cast("double") / n, lit(1))


def residuals(df: DataFrame) -> DataFrame:
    """Signed and absolute residuals on a grid, so that ties do not hang on the last bit."""
    r = F.round(F.col("y") - F.col("yhat"), GRID)
    return known(df).withColumns({"residual": r, "abs_residual": F.abs(r)})


def symmetric(df: DataFrame, group: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """``(group.., n, half_width)``."""
    return group_quantiles(settle(residuals(df)), group, "abs_residual", {"half_width": level(alpha)})


def asymmetric(df: DataFrame, group: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """``(group.., n, low, high)``: signed offsets around the prediction."""
    n = F.col("n").cast("double")
    half = alpha / 2
    up = F.least(F.ceil(F.round((1 - half) * (n + 1), 9)).cast("double") / n, lit(1))
    down = F.greatest(F.floor(F.round(half * (n + 1), 9)).cast("double") / n, lit(0))
    return group_quantiles(settle(residuals(df)), group, "residual", {"low": down, "high": up})


def split_calibration(df: DataFrame, group: Sequence[str], share: float = 0.25, minimum: int = 5) -> DataFrame:
    """Rows of the last periods of each group: at least ``minimum`` rows and ``share`` of all.

    Whole periods are taken from the end; counts per period, one row each, decide."""
    per = df.groupBy(*group, PERIOD).agg(F.count(F.lit(1)).alias("_c"))
    late = Window.partitionBy(*group).orderBy(F.col(PERIOD).desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("_c").over(Window.partitionBy(*group))
    need = F.greatest(F.lit(minimum).cast("double"), whole * share)
    cut = settle(
        per.withColumns({"_later": F.coalesce(F.sum("_c").over(late), F.lit(0)), "_need": need})
        .where("_later < _need")
        .select(*group, PERIOD)
    )
    return df.join(cut, [*group, PERIOD], "left_semi")


def predict(df: DataFrame, widths: DataFrame, group: Sequence[str]) -> DataFrame:
    """Add ``lower`` and ``upper`` from symmetric or asymmetric widths."""
    table = widths.drop("n")
    joined = attach(df, settle(table), group)
    if "half_width" in widths.columns:
        low, high = F.col("yhat") - F.col("half_width"), F.col("yhat") + F.col("half_width")
    else:
        low, high = F.col("yhat") + F.col("low"), F.col("yhat") + F.col("high")
    return joined.select(*df.columns, low.alias("lower"), high.alias("upper"))


def gaussian(df: DataFrame, sd: str, z: float = 1.6448536269514722) -> DataFrame:
    """Prediction plus and minus z times its sd (z of the 90 % interval by default)."""
    return df.withColumns({"lower": F.col("yhat") - z * F.col(sd), "upper": F.col("yhat") + z * F.col(sd)})


def coverage(df: DataFrame, group: Sequence[str], target: float = 0.9) -> DataFrame:
    """Coverage of the true value and width per group; passes above target - 10 %."""
    inside = (F.col("y") >= F.col("lower")) & (F.col("y") <= F.col("upper"))
    rows = df.where(F.col("y").isNotNull() & F.col("lower").isNotNull())
    share = F.avg(inside.cast("double"))
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        share.alias("coverage"),
        F.avg(F.col("upper") - F.col("lower")).alias("mean_width"),
        (share >= target - 0.1).alias("passes"),
    )


def stratum_edges(df: DataFrame, rate: str, group: Sequence[str], strata: int = 3) -> DataFrame:
    """``(group.., edges)``: distinct quantile edges of the missing share."""
    rows = settle(df.where(F.col(rate).isNotNull()).withColumn("_rate", F.round(rate, GRID)))
    levels = {f"q{i}": i / strata for i in range(strata + 1)}
    q = group_quantiles(rows, group, "_rate", levels)
    return q.select(*group, F.array_sort(F.array_distinct(F.array(*levels))).alias("edges"))


def stratum(rate: Column, edges: Column, calibrating: bool) -> Column:
    """Bin number. Calibration bins are closed on the left (the last on both sides);
    new rows take the first bin whose upper edge is not below the rate."""
    r = F.round(rate, GRID)
    last = F.greatest(F.size(edges) - 2, F.lit(0))
    upper = F.slice(edges, 2, F.greatest(F.size(edges), F.lit(1)))
    n = F.size(F.filter(upper, lambda e: (e <= r) if calibrating else (e < r)))
    return F.least(n, last)


def stratified(df: DataFrame, rate: str, group: Sequence[str], alpha: float = 0.1, strata: int = 3, minimum: int = 5):
    """Half-widths by share of missing features. Returns ``(edges, widths)``; a bin with
    fewer than ``minimum`` rows takes the global half-width of its group."""
    rows = residuals(df).where(F.col(rate).isNotNull())
    edges = settle(stratum_edges(rows, rate, group, strata))
    placed = settle(attach(rows, edges, group).withColumn("stratum", stratum(F.col(rate), F.col("edges"), True)))
    per = group_quantiles(placed, [*group, "stratum"], "abs_residual", {"half_width": level(alpha)})
    whole = group_quantiles(placed, group, "abs_residual", {"_all": level(alpha)}).drop("n")
    widths = per.join(settle(whole), list(group)).select(
        *group, "stratum", "n", F.when(F.col("n") < minimum, F.col("_all")).otherwise(F.col("half_width")).alias("half_width")
    )
    return edges, widths


def quantile_scores(df: DataFrame) -> DataFrame:
    """Conformity of quantile forecasts: max(lo - y, y - hi)."""
    s = F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi"))
    return df.where(F.col("y").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull()).withColumn(
        "score", F.round(s, GRID)
    )


def conformalised_quantiles(df: DataFrame, group: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """``(group.., n, shift, miss_rate)``: widen (or narrow) quantile forecasts by ``shift``."""
    rows = settle(quantile_scores(df))
    q = group_quantiles(rows, group, "score", {"shift": level(alpha)})
    miss = rows.groupBy(*group).agg(F.avg((F.col("score") > 0).cast("double")).alias("miss_rate"))
    return q.join(miss, list(group))


def past_quantile_bands(df: DataFrame, group: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """Quantile forecasts ``lo``, ``hi`` from an entity's own earlier residuals around yhat.

    The frame is one entity's earlier periods, so the exact percentile is small."""
    w = Window.partitionBy(*group, ENTITY).orderBy(PERIOD).rowsBetween(Window.unboundedPreceding, -1)
    rows = residuals(df)
    return rows.withColumns(
        {
            "lo": F.col("yhat") + F.min("residual").over(w) * (1 - alpha),
            "hi": F.col("yhat") + F.max("residual").over(w) * (1 - alpha),
        }
    )
