"""Ranks, running sums and quantiles inside groups of any size.

Groups up to ``WINDOW_ROWS`` rows use an ordinary window. Beyond that, equal
values are counted first (a map-side combine, so a value held by a third of all
rows costs one row), the distinct values are cut into buckets at approximate
quantiles, each bucket is one window partition, and the totals of the earlier
buckets are added. Where the cuts fall changes the work split, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.guards import join_groups, lit, ratio
from panelwise.session import settle

WINDOW_ROWS = 1_000_000


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Rows of the biggest group: one map-side combined count, one number back."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def _with_buckets(df: DataFrame, group: list[str], key: str, biggest: int, limit: int) -> DataFrame:
    n_cuts = 2 * math.ceil(biggest / limit)
    levels = [i / n_cuts for i in range(1, n_cuts)]
    cuts = settle(df.groupBy(*group).agg(F.percentile_approx(key, levels, 10_000).alias("_cuts")))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(key)))
    return join_groups(df, cuts, group, "inner").withColumn("_bucket", below).drop("_cuts")


def running_sums(
    distinct: DataFrame,
    group: Sequence[str],
    key: str,
    sums: Mapping[str, Column],
    limit: int | None = None,
    biggest: int | None = None,
) -> DataFrame:
    """Add running sums over ``key`` (unique within a group), current row included.

    ``biggest``: a bound on the rows of a group, if known; else they are counted."""
    group, limit = list(group), limit or WINDOW_ROWS
    biggest = largest_group(distinct, group) if biggest is None else biggest
    if biggest <= limit:
        w = Window.partitionBy(*group).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        return distinct.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    parts = _with_buckets(distinct, group, key, biggest, limit).withColumns(
        {f"_in_{n}": c for n, c in sums.items()}
    )
    slot = [*group, "_bucket"]
    per_bucket = parts.groupBy(*slot).agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums])
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(
        per_bucket.select(*slot, *[F.sum(f"_sum_{n}").over(earlier).alias(f"_before_{n}") for n in sums])
    )
    w = Window.partitionBy(*slot).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    inside = parts.withColumns({n: F.sum(f"_in_{n}").over(w) for n in sums})
    joined = join_groups(inside, offsets, slot, "inner")
    done = joined.withColumns({n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in sums})
    return done.drop("_bucket", *[f"_in_{n}" for n in sums], *[f"_before_{n}" for n in sums])


def value_counts(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``(group.., value, _n)``: equal values collapse before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))


def add_ranks(
    df: DataFrame,
    group: Sequence[str],
    ranks: Mapping[str, tuple[str, bool, str]],
    limit: int | None = None,
    biggest: int | None = None,
) -> DataFrame:
    """Add rank columns ``{name: (value, descending, method)}`` within ``group``.

    ``min``: 1 + number of better rows. ``truncated``: the average rank of the
    tied rows, cut to an integer. ``average``: the average rank. A NULL value
    has a NULL rank. ``biggest``: a bound on the rows of a group, if known; else they are counted.
    """
    group, limit = list(group), limit or WINDOW_ROWS
    small = (largest_group(df, group) if biggest is None else biggest) <= limit
    for name, (value, descending, method) in ranks.items():
        if small:
            order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
            placed = Window.partitionBy(*group).orderBy(order)
            first = F.rank().over(placed).cast("long")
            ties = F.count(F.lit(1)).over(placed.rangeBetween(Window.currentRow, Window.currentRow))  # one sort for both
            df = df.withColumn(name, F.when(F.col(value).isNotNull(), _rank_of(first, ties, method)))
        else:
            table = rank_table(df, group, value, descending, method, limit).withColumnRenamed("_rank", name)
            df = join_groups(df, table, [*group, value])
    return df


def _rank_of(first: Column, ties: Column, method: str) -> Column:
    if method == "min":
        return first
    if method == "truncated":
        return first + F.floor((ties - 1) / lit(2)).cast("long")
    if method == "average":
        return first.cast("double") + (ties - 1) / lit(2)
    raise ValueError(f"unknown rank method {method!r}")


def rank_table(
    df: DataFrame, group: Sequence[str], value: str, descending: bool, method: str, limit: int | None = None
) -> DataFrame:
    """``(group.., value, _rank)`` for every distinct value, from running counts."""
    group = list(group)
    counts = settle(value_counts(df, group, value))
    order = -F.col(value) if descending else F.col(value)
    run = running_sums(counts.withColumn("_key", order), group, "_key", {"_upto": F.col("_n")}, limit)
    first = F.col("_upto") - F.col("_n") + 1
    return run.select(*group, value, _rank_of(first, F.col("_n"), method).alias("_rank"))


def spearman(df: DataFrame, group: Sequence[str], a: str, b: str, name: str = "rho", limit: int | None = None) -> DataFrame:
    """Spearman correlation per group: Pearson of average ranks, NULL where one side is flat."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    group = list(group)
    keyed = both if group else both.withColumn("_g", F.lit(0))
    ranked = add_ranks(
        keyed, group or ["_g"], {"_ra": (a, True, "average"), "_rb": (b, True, "average")}, limit
    )
    return ranked.groupBy(*group).agg(pearson("_ra", "_rb").alias(name), F.count(F.lit(1)).alias("n"))


def pearson(a: str, b: str) -> Column:
    """Correlation aggregate that is NULL, not an error, on a constant column."""
    return ratio(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def group_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    levels: Mapping[str, float | Column],
    limit: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, plus the count ``n``.

    A level may be a column expression over ``n``. No group is gathered in one
    buffer: positions are found on running counts of distinct values.
    """
    group = list(group)
    src = df if group else df.withColumn("_g", F.lit(0))
    keys = group or ["_g"]
    counts = settle(value_counts(src, keys, value))
    run = running_sums(counts, keys, value, {"_upto": F.col("_n")}, limit)
    sizes = settle(counts.groupBy(*keys).agg(F.sum("_n").alias("n")))
    at = join_groups(run, sizes, keys, "inner").withColumn("_from", F.col("_upto") - F.col("_n"))
    aggs = [F.first("n").alias("n")]
    for name, level in levels.items():
        q = lit(level) if isinstance(level, (int, float)) else level
        h = q * (F.col("n") - 1).cast("double")
        at = at.withColumn(f"_h_{name}", h)
        for tag, pos in (("lo", F.floor(f"_h_{name}")), ("hi", F.ceil(f"_h_{name}"))):
            here = (pos >= F.col("_from")) & (pos < F.col("_upto"))
            aggs.append(F.max(F.when(here, F.col(value))).alias(f"_{tag}_{name}"))
        aggs.append(F.first(F.col(f"_h_{name}") - F.floor(f"_h_{name}")).alias(f"_t_{name}"))
    out = at.groupBy(*keys).agg(*aggs)
    cols = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_t_{n}")).alias(n) for n in levels
    ]
    return out.select(*group, "n", *cols)


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group under a total order.

    Spark turns ``row_number() <= n`` into a group limit that also runs before
    the shuffle, so at most n rows per group and task are moved.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= n).drop("_row")
