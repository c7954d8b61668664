"""Time features of panel components.

All windows run over one entity's periods, at most one row per period, on a
dense grid: one shuffle by entity serves the grid and every feature.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.guards import all_of, any_of, lit, present, ratio, total
from panelwise.operators.ordered import add_ranks, group_quantiles
from panelwise.operators.passes import attach
from panelwise.operators.scaling import period_min_max
from panelwise.panel import ENTITY, PERIOD, to_long
from panelwise.session import settle

LAGS = (1, 2, 3)
WINDOWS = (3, 5)
SPANS = (3, 5)


def dense(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every entity x every period of the panel, missing rows as NULL.

    An entity's rows (one per period) become a map and are read back for each
    period, so no entity x period join is needed and rows stay where they are."""
    periods = df.agg(F.sort_array(F.collect_set(PERIOD))).scalar()
    kept = df.groupBy(ENTITY).agg(
        F.map_from_entries(F.collect_list(F.struct(PERIOD, F.struct(*columns)))).alias("_rows")
    )
    grid = kept.select(ENTITY, "_rows", F.posexplode(periods).alias("position", PERIOD))
    row = F.try_element_at("_rows", F.col(PERIOD))
    return grid.select(ENTITY, PERIOD, "position", *[row.getField(c).alias(c) for c in columns])


def over_time() -> Window:
    return Window.partitionBy(ENTITY).orderBy(PERIOD)


def lag_features(grid: DataFrame, columns: Sequence[str], lags: Sequence[int] = LAGS) -> DataFrame:
    """Current values, lags and was-missing flags; a missing lag gets the median of its
    period (of the current period where no lag period exists)."""
    w = over_time()
    long = to_long(grid, columns, keep_missing=False)
    medians = settle(group_quantiles(settle(long), [PERIOD, "indicator"], "value", {"median": 0.5}))
    table = medians.groupBy(PERIOD).agg(
        *[F.max(F.when(F.col("indicator") == c, F.col("median"))).alias(f"_med_{c}") for c in columns]
    )
    placed = attach(grid, settle(table), [PERIOD])
    out: dict[str, Column] = {}
    for c in columns:
        out[f"{c}_current"] = F.col(c)
        med = F.coalesce(F.col(f"_med_{c}"), lit(0))
        for k in lags:
            value = F.lag(c, k).over(w)
            fill = F.when(F.col("position") >= k, F.coalesce(F.lag(med, k).over(w), lit(0))).otherwise(med)
            out[f"{c}_lag{k}"] = F.coalesce(value, fill)
            out[f"{c}_lag{k}_missing"] = value.isNull().cast("long")
    return placed.select(ENTITY, PERIOD, *[v.alias(n) for n, v in out.items()])


def rolling_features(grid: DataFrame, columns: Sequence[str], windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Mean, sd (one value: 0), min and max of the last periods; NULL until the window is full."""
    out = {}
    for c in columns:
        for n in windows:
            w = over_time().rowsBetween(-(n - 1), 0)
            full = F.col("position") >= n - 1
            out[f"{c}_roll{n}_mean"] = F.when(full, F.avg(c).over(w))
            out[f"{c}_roll{n}_sd"] = F.when(full, F.coalesce(F.stddev_samp(c).over(w), lit(0)))
            out[f"{c}_roll{n}_min"] = F.when(full, F.min(c).over(w))
            out[f"{c}_roll{n}_max"] = F.when(full, F.max(c).over(w))
    return grid.select(ENTITY, PERIOD, *[v.alias(n) for n, v in out.items()])


def rolling_skewness(grid: DataFrame, columns: Sequence[str], size: int = 5) -> DataFrame:
    """Population skewness of the last periods, from 3 values on; 0-variance gives NULL."""
    w = over_time().rowsBetween(-(size - 1), 0)
    out = [
        F.when((F.col("position") >= size - 1) & (F.count(c).over(w) >= 3), F.skewness(c).over(w)).alias(f"{c}_skew{size}")
        for c in columns
    ]
    return grid.select(ENTITY, PERIOD, *out)


def momentum_features(grid: DataFrame, columns: Sequence[str], cut: int | None = None) -> DataFrame:
    """Momentum, acceleration, lagged difference; level and momentum less the entity's
    mean over the periods up to ``cut`` (the training periods of a fold)."""
    w, whole = over_time(), Window.partitionBy(ENTITY)
    inside = F.lit(True) if cut is None else F.col(PERIOD) <= cut
    out = {}
    for c in columns:
        d1 = F.col(c) - F.lag(c, 1).over(w)
        d2 = F.lag(c, 1).over(w) - F.lag(c, 2).over(w)
        out |= {f"{c}_momentum": d1, f"{c}_delta2": d2}
    moved = grid.withColumns(out)
    more = {}
    for c in columns:
        mean = F.coalesce(F.avg(F.when(inside, F.col(c))).over(whole), lit(0))
        mean_delta = F.coalesce(F.avg(F.when(inside, F.col(f"{c}_momentum"))).over(whole), lit(0))
        more[f"{c}_acceleration"] = F.col(f"{c}_momentum") - F.col(f"{c}_delta2")
        more[f"{c}_demeaned"] = F.col(c) - mean
        more[f"{c}_demeaned_momentum"] = F.col(f"{c}_momentum") - mean_delta
    return moved.withColumns(more).select(ENTITY, PERIOD, *out, *more)


def with_decayed_means(grid: DataFrame, means: dict[str, tuple[str, float]]) -> DataFrame:
    """Add ``{name: (column, base)}``: the mean of the column so far, a value ``k`` periods back weighing
    ``base ** -k``; only on rows that have a value.

    Powers are taken inside blocks of periods so short that they stay finite, and the block before joins with its
    factor; what lies further back weighs less than a double can tell."""
    inner, late = {}, {}
    for name, (c, base) in means.items():
        size = int(150 / math.log10(base))
        block = F.floor(F.col("position") / size)
        inside = Window.partitionBy(ENTITY, block).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
        up = F.when(F.col(c).isNotNull(), F.pow(lit(base), (F.col("position") % size).cast("double")))
        inner[f"{name}_sums"] = F.when(
            F.col(c).isNotNull(), F.struct("position", block.alias("block"), F.sum(F.col(c) * up).over(inside).alias("top"), F.sum(up).over(inside).alias("all"))
        )
        earlier = Window.partitionBy(ENTITY).orderBy(block).rangeBetween(Window.unboundedPreceding, -1)
        past = F.max(f"{name}_sums").over(earlier)
        now = F.col(f"{name}_sums")
        factor = F.pow(lit(base), -((now["block"] - past["block"]) * size).cast("double"))
        carry = lambda part, past=past, factor=factor: F.coalesce(past[part] * factor, lit(0))
        late[name] = (now["top"] + carry("top")) / (now["all"] + carry("all"))
    return grid.withColumns(inner).withColumns(late).drop(*inner)


def trend_features(grid: DataFrame, columns: Sequence[str], spans: Sequence[int] = SPANS) -> DataFrame:
    """Slope to date (3 values at least), exponentially weighted means, expanding mean.

    Weights count periods, so a gap keeps its distance."""
    w = over_time().rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("position").cast("double")
    out = {}
    grid = with_decayed_means(grid, {f"_{c}_ewma{s}": (c, (s + 1) / (s - 1)) for c in columns for s in spans})
    for c in columns:
        out[f"{c}_trend"] = F.when(F.count(c).over(w) >= 3, F.regr_slope(F.col(c), x).over(w))
        for s in spans:
            out[f"{c}_ewma{s}"] = F.last(f"_{c}_ewma{s}", ignorenulls=True).over(w)
        out[f"{c}_expanding"] = F.avg(c).over(w)
    return grid.select(ENTITY, PERIOD, *[v.alias(n) for n, v in out.items()])


def diversity_features(grid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spread across the components of a row: sd (ddof 0) and range, from 2 values on."""
    values = F.filter(F.array(*[F.col(c) for c in columns]), lambda v: v.isNotNull())
    n = F.size("_v")
    mean = F.aggregate("_v", lit(0), lambda a, v: a + v) / n
    ss = F.aggregate("_v", lit(0), lambda a, v: a + (v - F.col("_mean")) * (v - F.col("_mean")))
    rows = grid.withColumn("_v", values).withColumn("_mean", F.when(n >= 2, mean))
    return rows.select(
        ENTITY,
        PERIOD,
        F.when(n >= 2, F.sqrt(ss / n)).alias("diversity_sd"),
        F.when(n >= 2, F.array_max("_v") - F.array_min("_v")).alias("diversity_range"),
    )


def cross_entity_features(grid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(entity, period, component, percentile, zscore, rank_change)`` against the
    complete entities of the period (an entity outside that cohort: against all
    present values). Defaults 0.5, 0 and 0."""
    has = grid.groupBy(PERIOD).agg(*[(F.count(c) > 0).alias(f"has_{c}") for c in columns])
    rows = attach(grid, settle(has), [PERIOD])
    cohort = all_of(F.col(c).isNotNull() | ~F.col(f"has_{c}") for c in columns) & any_of(
        F.col(f"has_{c}") for c in columns
    )
    long = to_long(rows.withColumn("_cohort", cohort), columns, ids=(ENTITY, PERIOD, "position", "_cohort"))
    long = settle(long.withColumnRenamed("indicator", "component"))
    key = [PERIOD, "component"]
    seen = F.col("value").isNotNull()
    inside = F.when(F.col("_cohort"), F.col("value"))
    stats = settle(
        long.groupBy(*key).agg(
            F.count("value").alias("_n"),
            F.avg("value").alias("_mean"),
            F.stddev_samp("value").alias("_sd"),
            F.count(inside).alias("_cn"),
            F.avg(inside).alias("_cmean"),
            F.stddev_samp(inside).alias("_csd"),
        )
    )
    ranked = add_ranks(
        attach(long.withColumn("_inside", inside), stats, key),
        key,
        {"_r": ("value", False, "min"), "_cr": ("_inside", False, "min")},
    )
    c = F.col("_cohort")
    below = F.when(c, ratio((F.col("_cr") - 1).cast("double"), F.col("_cn"))).otherwise(
        ratio((F.col("_r") - 1).cast("double"), F.col("_n"))
    )
    z = F.when(c, (F.col("value") - F.col("_cmean")) / (F.col("_csd") + 1e-10)).otherwise(
        (F.col("value") - F.col("_mean")) / (F.col("_sd") + 1e-10)
    )
    placed = ranked.withColumns(
        {"percentile": F.when(seen, below).otherwise(lit(0.5)), "zscore": F.when(seen, z).otherwise(lit(0))}
    )
    w = Window.partitionBy(ENTITY, "component").orderBy(PERIOD)
    change = F.when(F.lag("value").over(w).isNotNull(), F.col("percentile") - F.lag("percentile").over(w)).otherwise(lit(0))
    return placed.select(ENTITY, PERIOD, "component", "percentile", "zscore", change.alias("rank_change"))


def region_features(entities: DataFrame, regions: DataFrame, names: Sequence[str], region: str = "region") -> DataFrame:
    """One-hot region columns through the entity's own register entry."""
    joined = entities.join(regions, ENTITY, "left")
    return joined.select(
        ENTITY, *[F.coalesce((F.col(region) == n).cast("long"), F.lit(0)).alias(f"region_{i}") for i, n in enumerate(names)]
    )


def training_pairs(grid: DataFrame, columns: Sequence[str], holdout: int | None = None) -> DataFrame:
    """``(entity, period, target_period, x_*, y_*)``: features of a period with the next
    period's values, where those are complete. ``holdout`` is left out as a target."""
    w = over_time()
    ahead = {f"y_{c}": F.lead(c).over(w) for c in columns}
    rows = grid.withColumns(ahead | {"target_period": F.lead(PERIOD).over(w)})
    done = present(F.col(f"y_{c}") for c in columns) == len(list(columns))
    keep = done if holdout is None else done & (F.col("target_period") != holdout)
    return rows.where(keep).select(
        ENTITY, PERIOD, "target_period", *[F.col(c).alias(f"x_{c}") for c in columns], *[f"y_{c}" for c in columns]
    )


def prediction_rows(grid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per entity the last period, or the latest one with any value."""
    some = present(F.col(c) for c in columns) > 0
    best = F.max_by(F.struct(PERIOD, *columns), F.struct(some.cast("int").alias("s"), F.col(PERIOD).alias("p")))
    return grid.groupBy(ENTITY).agg(best.alias("_b")).select(ENTITY, "_b.*")


def saw_targets(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return period_min_max(df, columns, [PERIOD])


def fold_medians(grid: DataFrame, columns: Sequence[str], fold: int) -> DataFrame:
    """Median by period and component over the entities that have data before ``fold``."""
    known = grid.where((F.col(PERIOD) < fold) & (present(F.col(c) for c in columns) > 0)).select(ENTITY).distinct()
    long = to_long(grid.join(known, ENTITY, "left_semi"), columns, keep_missing=False)
    return group_quantiles(settle(long), [PERIOD, "indicator"], "value", {"median": 0.5})


def target_counts(grid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Present values per component."""
    cells = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"_{c}").alias("n_valid")) for c in columns])
    return grid.agg(*[F.count(c).alias(f"_{c}") for c in columns]).select(F.inline(cells))


def baseline_forecasts(grid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(entity, period, component, y, model, yhat)`` of three one-step baselines that use
    earlier periods only: last value, mean so far, exponentially weighted mean.

    An entity's last value is its own; see :func:`global_last` for one value for all."""
    w = over_time().rowsBetween(Window.unboundedPreceding, -1)
    cells = []
    grid = with_decayed_means(grid, {f"_{c}_so_far": (c, 2.0) for c in columns})
    for c in columns:
        for name, value in (
            ("last", F.last(c, ignorenulls=True).over(w)),
            ("mean", F.avg(c).over(w)),
            ("ewma", F.last(f"_{c}_so_far", ignorenulls=True).over(w)),
        ):
            cells.append((c, name, value))
    wide = grid.select(ENTITY, PERIOD, *columns, *[v.alias(f"_{c}_{m}") for c, m, v in cells])
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("component"),
                F.col(c).alias("y"),
                F.lit(m).alias("model"),
                F.col(f"_{c}_{m}").alias("yhat"),
            )
            for c, m, _ in cells
        ]
    )
    return wide.select(ENTITY, PERIOD, F.inline(rows))


def global_last(grid: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The last complete row of the panel (latest period, then entity) as one constant."""
    best = F.max_by(F.struct(*columns), F.struct(PERIOD, ENTITY))
    rows = grid.where(all_of(F.col(c).isNotNull() for c in columns))
    return rows.agg(best.alias("_b")).select("_b.*")


def missing_share(grid: DataFrame, columns: Sequence[str]) -> Column:
    columns = list(columns)
    return (len(columns) - present(F.col(c) for c in columns)) / lit(len(columns))


def feature_table(grid: DataFrame, columns: Sequence[str], cut: int | None = None) -> DataFrame:
    """All per-entity features in one row per (entity, period), without another shuffle
    than the grid's: each family is a projection over the same entity windows."""
    out = lag_features(grid, columns)
    for part in (
        rolling_features(grid, columns),
        momentum_features(grid, columns, cut),
        trend_features(grid, columns),
        diversity_features(grid, columns),
    ):
        out = out.join(part, [ENTITY, PERIOD])
    return out


def row_total(columns: Sequence[str]) -> Column:
    return total(F.col(c) for c in columns)
