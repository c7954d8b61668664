"""The panel: one row per (entity, period), one DOUBLE column per indicator.

The wide layout keeps every row-wise operator (composites, complete-case flags,
weighted sums, normalisation) free of shuffles, and turns every column
statistic into one map-side combined aggregation. The set of indicators is
schema, so the hierarchy is a plain Python mapping; only data lives in Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

ENTITY = "entity"
PERIOD = "period"


@dataclass(frozen=True)
class Hierarchy:
    """Criterion -> its indicators, plus the indicators where lower is better."""

    groups: Mapping[str, tuple[str, ...]]
    cost: frozenset[str] = field(default_factory=frozenset)

    @property
    def criteria(self) -> list[str]:
        return sorted(self.groups)

    @property
    def indicators(self) -> list[str]:
        return [i for k in self.criteria for i in self.groups[k]]

    @property
    def criterion_of(self) -> dict[str, str]:
        return {i: k for k in self.criteria for i in self.groups[k]}


@dataclass(frozen=True)
class Panel:
    data: DataFrame
    hierarchy: Hierarchy
    # tables derived from this data that several operators share
    known: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    @property
    def indicators(self) -> list[str]:
        return self.hierarchy.indicators

    @property
    def spark(self):
        return self.data.sparkSession

    def with_data(self, data: DataFrame) -> Panel:
        return replace(self, data=data, known={})

    def long(self, keep_missing: bool = True) -> DataFrame:
        return to_long(self.data, self.indicators, self.hierarchy, keep_missing)


def to_long(
    data: DataFrame,
    columns: Iterable[str],
    hierarchy: Hierarchy | None = None,
    keep_missing: bool = True,
    ids: Iterable[str] = (ENTITY, PERIOD),
) -> DataFrame:
    """Wide -> ``(ids.., [criterion,] indicator, value)``."""
    columns = list(columns)
    out = data.select(*ids, *columns).unpivot(list(ids), columns, "indicator", "value")
    if hierarchy is not None:
        out = out.withColumn("criterion", criterion_name(F.col("indicator"), hierarchy))
    return out if keep_missing else out.where(F.col("value").isNotNull())


def criterion_name(indicator: Column, hierarchy: Hierarchy) -> Column:
    """Look the criterion of an indicator code up without a join."""
    pairs = [F.lit(x) for pair in sorted(hierarchy.criterion_of.items()) for x in pair]
    return F.element_at(F.create_map(*pairs), indicator)


def to_wide(obs: DataFrame, columns: Iterable[str], ids: Iterable[str] = (ENTITY, PERIOD)) -> DataFrame:
    """``(ids.., indicator, value)`` -> wide; one shuffle, known columns, map-side combine."""
    return obs.groupBy(*ids).agg(
        *[F.max(F.when(F.col("indicator") == c, F.col("value"))).alias(c) for c in columns]
    )
