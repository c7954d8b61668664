"""Availability of entities, indicators and criteria, and views of the panel.

All of these are row-wise on the wide panel or one map-side combined
aggregation by period; none shuffles the rows by entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwise.functions.guards import all_of, any_of, lit, present, row_mean
from panelwise.operators.critic import period_activity
from panelwise.panel import ENTITY, PERIOD, Panel, to_long
from panelwise.session import settle


def entity_activity(panel: Panel) -> DataFrame:
    """``(period, entity, n_present, active)``: active with at least one value."""
    n = present(F.col(c) for c in panel.indicators)
    return panel.data.select(PERIOD, ENTITY, n.alias("n_present"), (n > 0).alias("active"))


def period_counts(panel: Panel) -> DataFrame:
    """One row per period: ``n_<indicator>`` values present, and entity counts."""
    n = present(F.col(c) for c in panel.indicators)
    return panel.data.groupBy(PERIOD).agg(
        F.count(F.lit(1)).alias("n_entities"),
        F.sum((n > 0).cast("long")).alias("n_active_entities"),
        *[F.count(c).alias(f"n_{c}") for c in panel.indicators],
    )


def indicator_activity(panel: Panel) -> DataFrame:
    """``(period, criterion, indicator, n_present, active)``."""
    h = panel.hierarchy
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("criterion"),
                F.lit(c).alias("indicator"),
                F.col(f"n_{c}").alias("n_present"),
                (F.col(f"n_{c}") > 0).alias("active"),
            )
            for c, k in h.criterion_of.items()
        ]
    )
    return period_counts(panel).select(PERIOD, F.inline(rows))


def criterion_activity(panel: Panel) -> DataFrame:
    """``(period, criterion, n_active_indicators, active)``."""
    return indicator_activity(panel).groupBy(PERIOD, "criterion").agg(
        F.sum(F.col("active").cast("long")).alias("n_active_indicators"),
        F.max("active").alias("active"),
    )


def with_complete_flags(panel: Panel) -> DataFrame:
    """The rows plus ``complete_<criterion>``: every indicator of the criterion that
    is active in the period is present, and there is one."""
    h = panel.hierarchy
    rows = panel.data.join(period_activity(panel), PERIOD)
    flags = {}
    for k in h.criteria:
        has = [F.col(f"has_{c}") for c in h.groups[k]]
        filled = all_of(F.col(c).isNotNull() | ~a for c, a in zip(h.groups[k], has))
        flags[f"complete_{k}"] = filled & any_of(has)
    return rows.withColumns(flags)


def complete_cases(panel: Panel) -> DataFrame:
    """``(period, criterion, entity)`` usable in that criterion's decision matrix."""
    h = panel.hierarchy
    names = F.filter(
        F.array(*[F.when(F.col(f"complete_{k}"), F.lit(k)) for k in h.criteria]), lambda k: k.isNotNull()
    )
    return with_complete_flags(panel).select(PERIOD, ENTITY, F.explode(names).alias("criterion"))


def valid_pairs(panel: Panel) -> DataFrame:
    """``(period, entity, indicator, value)`` of the cells present."""
    return panel.long(keep_missing=False).select(PERIOD, ENTITY, "indicator", "value")


def is_valid(panel: Panel, probes: DataFrame) -> DataFrame:
    """Keep the ``(period, entity, indicator)`` probes whose cell is present."""
    return probes.join(valid_pairs(panel), [PERIOD, ENTITY, "indicator"], "left_semi")


def criterion_means(panel: Panel) -> DataFrame:
    """Wide: mean of the indicators present, per criterion."""
    h = panel.hierarchy
    return panel.data.select(
        ENTITY, PERIOD, *[row_mean(F.col(c) for c in h.groups[k]).alias(k) for k in h.criteria]
    )


def final_means(panel: Panel) -> DataFrame:
    """``(entity, period, final, n_criteria)``: mean of the criterion means present."""
    criteria = panel.hierarchy.criteria
    return criterion_means(panel).select(
        ENTITY,
        PERIOD,
        row_mean(F.col(k) for k in criteria).alias("final"),
        present(F.col(k) for k in criteria).alias("n_criteria"),
    )


def criterion_matrix(panel: Panel, criterion: str) -> DataFrame:
    """The clean decision matrix of one criterion, all periods; inactive columns stay NULL."""
    cols = panel.hierarchy.groups[criterion]
    return with_complete_flags(panel).where(F.col(f"complete_{criterion}")).select(PERIOD, ENTITY, *cols)


def entity_history(panel: Panel, entity, criteria: bool = False) -> DataFrame:
    view = criterion_means(panel) if criteria else panel.data
    return view.where(F.col(ENTITY) == F.lit(entity))


def valid_series(panel: Panel, entity, indicator: str) -> DataFrame:
    rows = panel.data.where((F.col(ENTITY) == F.lit(entity)) & F.col(indicator).isNotNull())
    return rows.select(PERIOD, F.col(indicator).alias("value"))


def period_slice(panel: Panel, period: int | None = None) -> DataFrame:
    """The cross-section of a period, the latest one by default."""
    at = panel.data.agg(F.max(PERIOD)).scalar() if period is None else F.lit(period)
    return panel.data.where(F.col(PERIOD) == at)


def availability_report(panel: Panel) -> DataFrame:
    """One row per period: counts, and the excluded indicators and criteria.

    Excluded entities are a count here and rows in :func:`entity_activity`: their
    list grows with the data.
    """
    h = panel.hierarchy

    def codes(names: Sequence[str], gone) -> Column:
        return F.concat_ws(",", *[F.when(gone(c), F.lit(c)) for c in names])

    lacks = {c: F.col(f"n_{c}") == 0 for c in h.indicators}
    empty = {k: all_of(lacks[c] for c in h.groups[k]) for k in h.criteria}
    indicators, criteria = h.indicators, h.criteria
    return period_counts(panel).select(
        PERIOD,
        "n_entities",
        "n_active_entities",
        (F.col("n_entities") - F.col("n_active_entities")).alias("n_excluded_entities"),
        sum(((~lacks[c]).cast("long") for c in indicators), F.lit(0)).alias("n_active_indicators"),
        sum(((~empty[k]).cast("long") for k in criteria), F.lit(0)).alias("n_active_criteria"),
        codes(indicators, lambda c: lacks[c]).alias("excluded_indicators"),
        codes(criteria, lambda k: empty[k]).alias("excluded_criteria"),
    )


def future_context(panel: Panel) -> DataFrame:
    """``(entity, period, criterion, indicator)`` expected in the next period: every
    entity with every indicator active in the latest one."""
    h = panel.hierarchy
    latest = panel.data.agg(F.max(PERIOD)).scalar()
    last = panel.data.where(F.col(PERIOD) == latest)
    codes = F.array(
        *[
            F.when(F.count(c) > 0, F.struct(F.lit(k).alias("criterion"), F.lit(c).alias("indicator")))
            for c, k in h.criterion_of.items()
        ]
    )
    active = last.agg(F.filter(codes, lambda s: s.isNotNull()).alias("codes")).scalar()
    entities = panel.data.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("_n"))
    return entities.select(ENTITY, (latest + 1).alias(PERIOD), F.inline(active))


def prepare_matrix(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], min_rows: int = 2, min_columns: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Drop empty rows, then columns empty in their group. Returns the rows and a
    report per group; groups below the minimum sizes raise."""
    filled = present(F.col(c) for c in columns) > 0
    report = settle(
        df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(filled.cast("long")).alias("n_kept_rows"),
            *[F.count(c).alias(f"n_{c}") for c in columns],
        )
    )
    kept = sum(((F.col(f"n_{c}") > 0).cast("long") for c in columns), F.lit(0))
    report = report.withColumn("n_kept_columns", kept)
    short = report.where((F.col("n_kept_rows") < min_rows) | (F.col("n_kept_columns") < min_columns))
    bad = short.select(*by).head(1)
    if bad:
        raise ValueError(f"decision matrix too small in group {bad[0].asDict()}")
    return df.where(filled), report


def matrix_report(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Kept and dropped rows and columns per group (rows first, then columns)."""
    _, report = prepare_matrix(df, columns, by, min_rows=0, min_columns=0)
    return report.select(
        *by,
        "n_rows",
        "n_kept_rows",
        (F.col("n_rows") - F.col("n_kept_rows")).alias("n_dropped_rows"),
        "n_kept_columns",
        (F.lit(len(columns)) - F.col("n_kept_columns")).alias("n_dropped_columns"),
        F.concat_ws(",", *[F.when(F.col(f"n_{c}") == 0, F.lit(c)) for c in columns]).alias("dropped_columns"),
    )


def usable_row_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(PERIOD).agg(F.count(F.lit(1)).alias("n_rows"))


def target_complete(df: DataFrame, columns: Sequence[str]) -> Column:
    """True where every target component is present."""
    return present(F.col(c) for c in columns) == len(list(columns))


def duplicate_keys(obs: DataFrame, keys: Sequence[str] = (PERIOD, ENTITY)) -> DataFrame:
    """Keys that occur more than once (map-side counted, so a hot key costs one row)."""
    return obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def structural_gaps(panel: Panel) -> DataFrame:
    """``(period, criterion, indicator)`` with no value at all in the period."""
    return indicator_activity(panel).where(~F.col("active")).select(PERIOD, "criterion", "indicator")


def null_counts(panel: Panel) -> DataFrame:
    """``(period, indicator, n_missing, n_rows)``."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("indicator"), (F.col("n_entities") - F.col(f"n_{c}")).alias("n_missing"))
            for c in panel.indicators
        ]
    )
    return period_counts(panel).select(PERIOD, F.col("n_entities").alias("n_rows"), F.inline(rows))


def compare_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only: ``(keys.., side)``."""
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()
    only_left = l.join(r, list(keys), "left_anti").withColumn("side", F.lit("left"))
    return only_left.unionByName(r.join(l, list(keys), "left_anti").withColumn("side", F.lit("right")))


def weighted_criteria(panel: Panel, local: dict[str, float] | None = None) -> DataFrame:
    """Criterion scores from indicators: weighted mean of those present, equal
    weights if none are given."""
    h = panel.hierarchy
    out = []
    for k in h.criteria:
        cols = h.groups[k]
        w = {c: lit(local[c] if local else 1.0) for c in cols}
        seen = sum((F.when(F.col(c).isNotNull(), w[c]).otherwise(lit(0)) for c in cols), lit(0))
        value = sum((F.coalesce(F.col(c), lit(0)) * w[c] for c in cols), lit(0))
        out.append(F.try_divide(value, seen).alias(k))
    return panel.data.select(ENTITY, PERIOD, *out)


def long_criteria(panel: Panel) -> DataFrame:
    """``(entity, period, criterion, value)`` of the criterion means."""
    return to_long(criterion_means(panel), panel.hierarchy.criteria).withColumnRenamed("indicator", "criterion")
