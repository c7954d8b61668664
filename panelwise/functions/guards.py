"""Expressions that stay defined on missing, constant and zero inputs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

SCORE_DIGITS = 10


def join_groups(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table of groups to rows; a NULL key is a group like any other."""
    renamed = table.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys])
    return df.join(renamed, same, how).drop(*[f"_key_{k}" for k in keys])


def lit(x: float) -> Column:
    return F.lit(float(x))


def clean(col: Column) -> Column:
    """NaN and infinities become NULL; NULL is the only missing value inside."""
    d = col.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (ANSI division would fail the job)."""
    return F.try_divide(a, b)


def total(cols: Iterable[Column]) -> Column:
    """Sum of columns, NULL as 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, lit(0)) for c in cols])


def present(cols: Iterable[Column]) -> Column:
    """How many of the columns are not NULL."""
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])


def row_mean(cols: Iterable[Column]) -> Column:
    """Mean of the columns that are not NULL; NULL if all are."""
    cols = list(cols)
    return ratio(total(cols), present(cols).cast("double"))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def smallest(cols: Iterable[Column]) -> Column:
    cols = list(cols)
    return cols[0] if len(cols) == 1 else F.least(*cols)


def largest(cols: Iterable[Column]) -> Column:
    cols = list(cols)
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def tidy(col: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 folded into 0.0: comparable across engines and partitionings."""
    return F.round(col, digits) + lit(0)


def score_key(col: Column) -> Column:
    """Order key of a [0, 1] score. Floating sums depend on partition order, so the
    last bits must not decide ties."""
    return tidy(col, SCORE_DIGITS)


def clip(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNotNull(), F.least(F.greatest(col, lit(low)), lit(high)))
