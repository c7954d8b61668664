"""Agreement between rankings, re-weighting, and rankings over several periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.guards import clip, lit, ratio, score_key, total
from panelwise.operators.ordered import add_ranks, spearman, top_n
from panelwise.operators.passes import with_stats
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle


def compromise_set(ranked: DataFrame, by: Sequence[str], entity: str) -> DataFrame:
    """VIKOR acceptance: advantage (Q2 - Q1 >= 1/(n-1)), stability (the leader is
    also first by S or R), and the entities of the compromise set.

    ``ranked`` has S, R, Q, rank_S, rank_R."""
    by = list(by)
    ranked = settle(ranked)
    order = [score_key(F.col("Q")).asc(), F.col(entity).asc()]
    w = Window.partitionBy(*by).orderBy(*order)
    two = top_n(ranked, by, order, 2).withColumn("_row", F.row_number().over(w))
    first = F.col("_row") == 1
    leaders = two.groupBy(*by).agg(
        F.max(F.when(first, F.col(entity))).alias("_a1"),
        F.max(F.when(~first, F.col(entity))).alias("_a2"),
        F.max(F.when(first, F.col("Q"))).alias("_q1"),
        F.max(F.when(~first, F.col("Q"))).alias("_q2"),
        F.max(F.when(first, (F.col("rank_S") == 1) | (F.col("rank_R") == 1))).alias("stability"),
    )
    sizes = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    gap = F.when(F.col("_n") > 1, ratio(lit(1), F.col("_n") - 1)).otherwise(lit(0))
    head = settle(
        leaders.join(sizes, by)
        .withColumn("_dq", gap)
        .withColumn("advantage", F.coalesce(F.col("_q2"), F.col("_q1")) - F.col("_q1") >= F.col("_dq"))
    )
    inside = (
        F.when(F.col("advantage") & F.col("stability"), F.col(entity) == F.col("_a1"))
        .when(~F.col("advantage"), F.col("Q") - F.col("_q1") < F.col("_dq"))
        .otherwise(F.col(entity).isin(F.col("_a1"), F.col("_a2")))
    )
    return ranked.join(head, by).where(inside).select(*by, entity, "Q", "advantage", "stability")


def kendall_w(ranks: DataFrame, group: Sequence[str], item: Sequence[str], rater: str, rank: str = "rank") -> DataFrame:
    """Concordance of the raters over the items of each group, clipped to [0, 1]."""
    sums = ranks.groupBy(*group, *item).agg(F.sum(rank).alias("_sum"), F.count(F.lit(1)).alias("_k"))
    agg = sums.groupBy(*group).agg(
        F.var_pop(F.col("_sum").cast("double")).alias("_var"),
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.max("_k").cast("double").alias("_k"),
    )
    n, k = F.col("_n"), F.col("_k")
    w = ratio(lit(12) * F.col("_var") * n, k * k * (n * n * n - n))
    return agg.select(*group, F.col("_n").cast("long").alias("n_items"), clip(w, 0, 1).alias("kendall_w"))


def criterion_scores(scores: DataFrame) -> DataFrame:
    """``(period, entity, criterion, mean)``: mean of the method scores, kept once for re-weighting."""
    return scores.groupBy(PERIOD, ENTITY, "criterion").agg(F.avg("score").alias("mean"))


def reweigh(means: DataFrame, scenarios: DataFrame, ranked: bool = True) -> DataFrame:
    """Composite under every weight scenario without running the methods again.

    ``scenarios``: ``(scenario, criterion, w)``; weights are normalised per scenario."""
    total_w = scenarios.groupBy("scenario").agg(F.sum("w").alias("_t"))
    share = settle(
        scenarios.join(total_w, "scenario").select(
            "scenario", "criterion", F.when(F.col("_t") > 0, ratio(F.col("w"), F.col("_t"))).otherwise(F.col("w")).alias("_w")
        )
    )
    # few criteria: a row of means meets each scenario's weights where it lies, so rows are shuffled once, not once a scenario
    criteria = [r[0] for r in share.select("criterion").where("criterion IS NOT NULL").distinct().orderBy("criterion").collect()]
    if not criteria:
        return _ranked(means.join(share, "criterion").select("scenario", PERIOD, ENTITY, (F.col("mean") * F.col("_w")).alias("composite")), ranked)
    of = lambda c: F.sum(F.when(F.col("criterion") == c, F.col("_w")))
    weights = share.groupBy("scenario").agg(*[of(c).alias(f"_w{i}") for i, c in enumerate(criteria)])
    wide = settle(
        means.where(F.col("criterion").isin(criteria)).groupBy(PERIOD, ENTITY).agg(
            *[F.sum(F.when(F.col("criterion") == c, F.col("mean"))).alias(f"_m{i}") for i, c in enumerate(criteria)]
        )
    )
    parts = [F.col(f"_m{i}") * F.col(f"_w{i}") for i in range(len(criteria))]
    composite = F.when(F.coalesce(*parts).isNotNull(), total(F.coalesce(v, lit(0)) for v in parts))
    out = wide.crossJoin(F.broadcast(settle(weights))).select("scenario", PERIOD, ENTITY, composite.alias("composite"))
    return _ranked(out, ranked)


def _ranked(out: DataFrame, ranked: bool) -> DataFrame:
    if not ranked:
        return out
    keyed = out.withColumn("_key", score_key(F.col("composite")))
    return add_ranks(keyed, ["scenario", PERIOD], {"rank": ("_key", True, "truncated")}).drop("_key")


def compare_rankings(df: DataFrame, group: Sequence[str], a: str, b: str, major: int = 5) -> DataFrame:
    """Spearman correlation, mean and largest difference, number of large differences."""
    rho = spearman(df, group, a, b, "rho").drop("n")
    gap = F.abs(F.col(a) - F.col(b))
    diffs = df.groupBy(*group).agg(
        F.avg(gap).alias("mean_difference"),
        F.max(gap).alias("max_difference"),
        F.sum((gap > major).cast("long")).alias("n_major"),
    )
    return diffs.join(rho, list(group))


def major_disagreements(df: DataFrame, a: str, b: str, major: int = 5) -> DataFrame:
    return df.withColumn("difference", F.abs(F.col(a) - F.col(b))).where(F.col("difference") > major)


# ------------------------------------------------------------ several periods


def period_order(df: DataFrame, period: str = PERIOD) -> DataFrame:
    """``(period, _i, _t)``: position of each period and their number; one row per period."""
    periods = df.groupBy(period).agg(F.count(F.lit(1)).alias("_c")).select(period)
    w = Window.partitionBy(F.lit(0)).orderBy(period)
    return settle(
        periods.withColumn("_i", F.row_number().over(w) - 1).withColumn(
            "_t", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
        )
    )


def multi_period(
    yearly: DataFrame,
    score: str,
    stability_of: str | None = None,
    discount: float = 0.9,
    trend_weight: float = 0.3,
    stability_weight: float = 0.2,
) -> DataFrame:
    """One composite per entity from its scores over time: discounted mean, slope over
    value range, and 1 - sd / largest sd; each part scaled over the entities.

    Entities without a score in some period get no composite, as a mean over
    unequal periods would not be comparable."""
    order = period_order(yearly)
    steady = stability_of or score
    rows = yearly.join(order, PERIOD)
    share = F.pow(lit(discount), F.col("_t") - 1 - F.col("_i"))
    per = settle(
        rows.groupBy(ENTITY).agg(
            F.sum(F.col(score) * share).alias("_ws"),
            F.sum(share).alias("_w"),
            F.regr_slope(F.col(score), F.col("_i").cast("double")).alias("_slope"),
            (F.max(score) - F.min(score)).alias("_range"),
            F.stddev_samp(steady).alias("_sd"),
            F.count(score).alias("_n"),
            F.max("_t").alias("_t"),
        )
        .where(F.col("_n") == F.col("_t"))
        .select(
            ENTITY,
            (F.col("_ws") / F.col("_w")).alias("discounted"),
            F.coalesce(F.col("_slope") / (F.col("_range") + 1e-10), lit(0)).alias("trend"),
            F.col("_sd"),
        )
    )
    placed = with_stats(
        per,
        [],
        {
            "_dlo": F.min("discounted"),
            "_dhi": F.max("discounted"),
            "_tlo": F.min("trend"),
            "_thi": F.max("trend"),
            "_smax": F.max("_sd"),
        },
    )

    def unit(x: str, lo: str, hi: str) -> Column:
        gap = F.col(hi) - F.col(lo)
        return F.when(gap > 0, ratio(F.col(x) - F.col(lo), gap)).otherwise(lit(0.5))

    stability = 1 - F.col("_sd") / F.when(F.col("_smax") > 0, F.col("_smax")).otherwise(lit(1))
    whole = (
        (1 - trend_weight - stability_weight) * unit("discounted", "_dlo", "_dhi")
        + trend_weight * unit("trend", "_tlo", "_thi")
        + stability_weight * F.col("stability")
    )
    out = placed.withColumn("stability", stability).withColumn("composite", whole)
    keyed = settle(out.select(ENTITY, "discounted", "trend", "stability", "composite", score_key(F.col("composite")).alias("_key"), F.lit(0).alias("_all")))
    return add_ranks(keyed, ["_all"], {"rank": ("_key", True, "truncated")}).drop("_key", "_all")


def discounted_mean(yearly: DataFrame, score: str, discount: float = 0.9, higher_is_better: bool = False) -> DataFrame:
    """Time-weighted mean of a score per entity, the weights normalised over all periods."""
    rows = yearly.join(period_order(yearly), PERIOD)
    share = F.pow(lit(discount), F.col("_t") - 1 - F.col("_i"))
    # closed form of the geometric sum of the weights, the same for every entity
    norm = (1 - F.pow(lit(discount), F.first("_t"))) / lit(1 - discount)
    per = settle(
        rows.groupBy(ENTITY).agg((F.sum(F.col(score) * share) / norm).alias("discounted"))
        .withColumn("_key", score_key(F.col("discounted")))
        .withColumn("_all", F.lit(0))
    )
    return add_ranks(per, ["_all"], {"rank": ("_key", higher_is_better, "truncated")}).drop("_key", "_all")
