"""Report tables over scores, ranks and weights.

Columns per method, criterion or period are pivoted with known names (schema),
as conditional aggregates in one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwise.functions.guards import lit, ratio, score_key
from panelwise.operators.ordered import add_ranks, group_quantiles, pearson, spearman
from panelwise.operators.passes import with_stats
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle

TIERS = ((0.10, "Elite"), (0.25, "High"), (0.50, "Upper-Mid"), (0.75, "Lower-Mid"))


def wide(df: DataFrame, ids: Sequence[str], key: str, value: str, keys: Sequence, names: Sequence[str] | None = None) -> DataFrame:
    """One column per key, one shuffle on the ids."""
    names = names or [str(k) for k in keys]
    return df.groupBy(*ids).agg(
        *[F.max(F.when(F.col(key) == F.lit(k), F.col(value))).alias(n) for k, n in zip(keys, names)]
    )


def periods_of(df: DataFrame, limit: int = 2000) -> list:
    """The periods as column names; refuses more than a schema can hold."""
    rows = df.select(PERIOD).distinct().orderBy(PERIOD).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} periods cannot become columns; use the long form")
    return [r[0] for r in rows]


def final_ranking(ranked: DataFrame, concordance: DataFrame) -> DataFrame:
    """Composite ranking with percentile, z-score, tier and Kendall's W per period."""
    placed = with_stats(
        ranked,
        [PERIOD],
        {"_n": F.count(F.lit(1)), "_mean": F.avg("composite"), "_sd": F.stddev_samp("composite")},
    ).join(concordance.select(PERIOD, "kendall_w"), PERIOD, "left")
    n, r = F.col("_n").cast("double"), F.col("rank")
    tier: Column = F.lit("Low")
    for cut, label in reversed(TIERS):
        tier = F.when(r <= n * cut, F.lit(label)).otherwise(tier)
    return placed.select(
        PERIOD,
        ENTITY,
        "composite",
        "rank",
        ((n - r + 1) / n * 100).alias("percentile"),
        F.when(F.col("_sd") > 0, ratio(F.col("composite") - F.col("_mean"), F.col("_sd"))).otherwise(lit(0)).alias("z_score"),
        tier.alias("tier"),
        "kendall_w",
    )


def scores_by_criterion(scores: DataFrame, methods: Sequence[str]) -> DataFrame:
    return wide(scores, [PERIOD, "criterion", ENTITY], "method", "score", methods)


def mean_method_scores(scores: DataFrame, ranked: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Mean score of each method over the criteria an entity has, and its composite."""
    means = scores.groupBy(PERIOD, ENTITY).agg(
        *[F.avg(F.when(F.col("method") == m, F.col("score"))).alias(m) for m in methods]
    )
    return means.join(ranked.select(PERIOD, ENTITY, "composite", "rank"), [PERIOD, ENTITY])


def top_by_mean_score(scores: DataFrame, methods: Sequence[str]) -> DataFrame:
    """The entity with the highest mean method score in every period."""
    means = scores.groupBy(PERIOD, ENTITY).agg(
        *[F.avg(F.when(F.col("method") == m, F.col("score"))).alias(m) for m in methods],
        F.avg("score").alias("mean_score"),
    )
    best = F.max_by(
        F.struct(ENTITY, *methods, "mean_score"), F.struct(score_key(F.col("mean_score")).alias("s"), (-F.col(ENTITY)).alias("e"))
    )
    return means.groupBy(PERIOD).agg(best.alias("_b")).select(PERIOD, "_b.*")


def rank_comparison(scores: DataFrame) -> DataFrame:
    """Mean, median, sd, best, worst and range of an entity's ranks over criteria x methods.

    A group holds at most criteria x methods rows, so the exact median is cheap."""
    return scores.groupBy(PERIOD, ENTITY).agg(
        F.avg("rank").alias("mean_rank"),
        F.percentile("rank", F.lit(0.5)).alias("median_rank"),
        F.stddev_samp("rank").alias("sd_rank"),
        F.min("rank").alias("best_rank"),
        F.max("rank").alias("worst_rank"),
        (F.max("rank") - F.min("rank")).alias("rank_range"),
    )


def score_matrix(ranked: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Entity x period composites, their mean, and the slope over the period positions."""
    position = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(periods) for x in (p, i)]), F.col(PERIOD))
    return ranked.groupBy(ENTITY).agg(
        *[F.max(F.when(F.col(PERIOD) == p, F.col("composite"))).alias(f"p{p}") for p in periods],
        F.avg("composite").alias("mean_score"),
        F.regr_slope(F.col("composite"), position.cast("double")).alias("trend"),
    )


def rank_matrix_by_period(ranked: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Entity x period ranks, mean, volatility (sd) and the best period (earliest on ties)."""
    return ranked.groupBy(ENTITY).agg(
        *[F.max(F.when(F.col(PERIOD) == p, F.col("rank"))).alias(f"p{p}") for p in periods],
        F.avg("rank").alias("mean_rank"),
        F.stddev_samp("rank").alias("volatility"),
        F.min_by(PERIOD, F.struct("rank", PERIOD)).alias("best_period"),
    )


def composite_comparison(scores: DataFrame, ranked: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Method composites (sum over criteria divided by ALL criteria of the period), their
    ranks, mean and rank range, next to the final composite."""
    per = scores.groupBy(PERIOD, ENTITY, "method").agg(F.sum("score").alias("_sum"))
    n = scores.groupBy(PERIOD).agg(F.count_distinct("criterion").alias("_k"))
    placed = settle(
        per.join(settle(n), PERIOD).select(PERIOD, ENTITY, "method", (F.col("_sum") / F.col("_k")).alias("score"))
        .withColumn("_key", score_key(F.col("score")))
    )
    ranks = add_ranks(placed, [PERIOD, "method"], {"rank": ("_key", True, "min")})
    table = ranks.groupBy(PERIOD, ENTITY).agg(
        *[F.max(F.when(F.col("method") == m, F.col("score"))).alias(m) for m in methods],
        *[F.max(F.when(F.col("method") == m, F.col("rank"))).alias(f"{m}_rank") for m in methods],
        F.avg("score").alias("mean_method_score"),
        (F.max("rank") - F.min("rank")).alias("rank_range"),
    )
    return table.join(
        ranked.select(PERIOD, ENTITY, F.col("composite"), F.col("rank").alias("composite_rank")), [PERIOD, ENTITY]
    )


def method_against_composite(comparison: DataFrame, methods: Sequence[str]) -> DataFrame:
    """``(period, method, rho)``: Spearman of each method's rank with the composite rank."""
    cells = F.array(
        *[F.struct(F.lit(m).alias("method"), F.col(f"{m}_rank").cast("double").alias("_r")) for m in methods]
    )
    rows = settle(comparison.select(PERIOD, F.col("composite_rank").cast("double").alias("_c"), F.inline(cells)))
    return spearman(rows, [PERIOD, "method"], "_r", "_c").drop("n")


def weight_table(weights_long: DataFrame, criteria_long: DataFrame) -> DataFrame:
    """Indicator weights with their rank per fit; criterion rows follow with rank 0."""
    # one row per indicator of the schema and fit
    w = Window.partitionBy("fit").orderBy(score_key(F.col("weight")).desc())
    top = weights_long.select(
        "fit", "indicator", "criterion", "weight", "criterion_weight", "local_weight", F.rank().over(w).cast("long").alias("rank")
    )
    rows = criteria_long.select(
        "fit",
        F.lit("[criterion]").alias("indicator"),
        "criterion",
        "weight",
        F.col("weight").alias("criterion_weight"),
        F.col("weight").alias("local_weight"),
        F.lit(0).cast("long").alias("rank"),
    )
    return top.unionByName(rows)


def weight_matrix(long: DataFrame, key: str, value: str, periods: Sequence[int]) -> DataFrame:
    """Key x period weights with mean and sd (ddof 1) over the periods."""
    return long.groupBy(key).agg(
        *[F.max(F.when(F.col("fit") == p, F.col(value))).alias(f"p{p}") for p in periods],
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
    )


def weight_deviation(criteria_long: DataFrame) -> DataFrame:
    """Weight minus the equal share, per fit."""
    n = F.count(F.lit(1)).over(Window.partitionBy("fit"))
    return criteria_long.select("fit", "criterion", "weight", (F.col("weight") - 1 / n).alias("deviation"))


# ------------------------------------------------------- tables behind charts


def method_agreement(scores: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Spearman between methods, ranks inside every (period, criterion) pooled."""
    inner = add_ranks(
        scores.withColumn("_key", score_key(F.col("score"))),
        [PERIOD, "criterion", "method"],
        {"_r": ("_key", False, "average")},
    )
    pooled = add_ranks(settle(inner.select(PERIOD, "criterion", ENTITY, "method", "_r")), ["method"], {"_rr": ("_r", False, "average")})
    table = wide(pooled, [PERIOD, "criterion", ENTITY], "method", "_rr", methods)
    pairs = [(a, b) for a in methods for b in methods if a < b]
    row = table.agg(*[pearson(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs]
    )
    return row.select(F.inline(cells))


def stability_across_criteria(scores: DataFrame) -> DataFrame:
    """Mean pairwise Spearman of a method's scores between criteria, entities matched."""
    a = scores.select(PERIOD, "method", ENTITY, F.col("criterion").alias("a"), F.col("score").alias("_x"))
    b = scores.select(PERIOD, "method", ENTITY, F.col("criterion").alias("b"), F.col("score").alias("_y"))
    # each entity meets itself: criteria x criteria rows per entity, not entity pairs
    both = settle(
        a.join(b, [PERIOD, "method", ENTITY]).where("a < b").select(
            PERIOD, "method", "a", "b", score_key(F.col("_x")).alias("_x"), score_key(F.col("_y")).alias("_y")
        )
    )
    rho = spearman(both, [PERIOD, "method", "a", "b"], "_x", "_y")
    return rho.groupBy(PERIOD, "method").agg(F.avg("rho").alias("mean_rho"), F.count("rho").alias("n_pairs"))


def persistence(scores: DataFrame) -> DataFrame:
    """Mean Spearman of a method's scores between consecutive periods, over all criteria.

    The window per (criterion, method, entity) holds one row per period."""
    w = Window.partitionBy("criterion", "method", ENTITY).orderBy(PERIOD)
    nxt = scores.withColumns({"_next": F.lead("score").over(w), "_at": F.lead(PERIOD).over(w)})
    both = settle(
        nxt.where(F.col("_at") == F.col(PERIOD) + 1).select(
            PERIOD, "criterion", "method", score_key(F.col("score")).alias("_x"), score_key(F.col("_next")).alias("_y")
        )
    )
    rho = spearman(both, [PERIOD, "criterion", "method"], "_x", "_y")
    return rho.groupBy("method").agg(F.avg("rho").alias("mean_rho"), F.count("rho").alias("n_pairs"))


def discriminating_power(scores: DataFrame) -> DataFrame:
    """Inter-quartile range of the weighted method composite, per period and method."""
    w = F.col("criterion_weight")
    comp = settle(
        scores.groupBy(PERIOD, "method", ENTITY)
        .agg(F.sum(F.col("score") * w).alias("_s"), F.sum(w).alias("_w"))
        .where("_w > 0")
        .select(PERIOD, "method", score_key(F.col("_s") / F.col("_w")).alias("value"))
    )
    q = group_quantiles(comp, [PERIOD, "method"], "value", {"q25": 0.25, "q75": 0.75})
    return q.select(PERIOD, "method", "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr"))


def score_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """``(method, bin, n)`` over [0, 1]; the last bin is closed."""
    slot = F.least(F.floor(score_key(F.col("score")) * bins), F.lit(bins - 1)).cast("long")
    return scores.groupBy("method", slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def score_distribution(scores: DataFrame) -> DataFrame:
    """Mean, sd and quartiles of each method's scores over all periods and criteria."""
    rows = settle(scores.select("method", score_key(F.col("score")).alias("score")))
    moments = rows.groupBy("method").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.min("score").alias("min"), F.max("score").alias("max")
    )
    q = group_quantiles(rows, ["method"], "score", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return q.join(moments, "method")


def rank_profiles(scores: DataFrame, ranked: DataFrame, n: int = 15) -> DataFrame:
    """Mean rank per method of the n best entities of each period, and its variance over methods."""
    best = settle(ranked.where(F.col("rank") <= n).select(PERIOD, ENTITY, F.col("rank").alias("composite_rank")))
    per = scores.join(best, [PERIOD, ENTITY]).groupBy(PERIOD, ENTITY, "composite_rank", "method").agg(F.avg("rank").alias("mean_rank"))
    spread = F.var_pop("mean_rank").over(Window.partitionBy(PERIOD, ENTITY))
    return per.withColumn("rank_variance", spread)


def method_fit(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Least-squares line and correlation of method b on method a, per criterion."""
    both = wide(scores.where(F.col("method").isin(a, b)), [PERIOD, "criterion", ENTITY], "method", "score", [a, b])
    return both.groupBy("criterion").agg(
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        pearson(a, b).alias("r"),
        F.count(F.lit(1)).alias("n"),
    )


def method_robustness(scores: DataFrame) -> DataFrame:
    """1 - sd / mean of the scores, floored at 0, per period, criterion and method."""
    cv = F.stddev_pop("score") / (F.avg("score") + 1e-10)
    return scores.groupBy(PERIOD, "criterion", "method").agg(F.greatest(1 - cv, lit(0)).alias("robustness"))


def rank_volatility(ranked: DataFrame, n: int = 10) -> DataFrame:
    """Sd of an entity's rank over the periods, and the share of periods among the n best."""
    return ranked.groupBy(ENTITY).agg(
        F.stddev_samp("rank").alias("volatility"),
        F.avg((F.col("rank") <= n).cast("double")).alias("share_top"),
        F.count(F.lit(1)).alias("n_periods"),
    )


def slopegraph(ranked: DataFrame, n: int = 10) -> DataFrame:
    """Ranks over all periods of the entities that are among the n best in the latest one."""
    last = ranked.agg(F.max(PERIOD)).scalar()
    best = settle(ranked.where((F.col(PERIOD) == last) & (F.col("rank") <= n)).select(ENTITY))
    return ranked.join(best, ENTITY, "left_semi").select(ENTITY, PERIOD, "rank")


def rank_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(entity, rank_before, rank_after, change)``; positive is a better rank."""
    a = before.select(ENTITY, F.col("rank").alias("rank_before"))
    b = after.select(ENTITY, F.col("rank").alias("rank_after"))
    return a.join(b, ENTITY).withColumn("change", F.col("rank_before") - F.col("rank_after"))


def level(col: Column) -> Column:
    """High / Medium / Low at 0.3 and 0.15."""
    return F.when(col >= 0.3, F.lit("High")).when(col >= 0.15, F.lit("Medium")).otherwise(F.lit("Low"))
