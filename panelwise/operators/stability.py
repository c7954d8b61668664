"""Stability of weights over time, and sensitivity under perturbation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwise.functions.guards import clip, lit, ratio, score_key
from panelwise.functions.noise import uniform
from panelwise.operators.ordered import add_ranks, largest_group, pearson, spearman
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle

TIERS = {"conservative": 0.05, "moderate": 0.15, "aggressive": 0.50}


def window_means(weights: DataFrame, size: int = 5, step: int = 1) -> DataFrame:
    """``(window, criterion, weight)``: mean weights over overlapping windows of periods.

    ``weights``: ``(fit, criterion, weight)``, one row per period and criterion."""
    order = Window.partitionBy("criterion").orderBy("fit")
    placed = weights.withColumns(
        {
            "_i": F.row_number().over(order) - 1,
            "_mean": F.avg("weight").over(order.rowsBetween(-(size - 1), 0)),
        }
    )
    full = placed.where((F.col("_i") >= size - 1) & ((F.col("_i") - (size - 1)) % step == 0))
    return full.select(
        ((F.col("_i") - (size - 1)) / step).cast("long").alias("window"), "criterion", F.col("_mean").alias("weight")
    )


def consecutive_rho(windows: DataFrame) -> DataFrame:
    """``(window, rho)``: Spearman between a window and the next; 1 where undefined."""
    w = Window.partitionBy("criterion").orderBy("window")
    pairs = settle(
        windows.withColumn("_next", F.lead("weight").over(w)).where(F.col("_next").isNotNull()).select(
            "window", score_key(F.col("weight")).alias("_a"), score_key(F.col("_next")).alias("_b")
        )
    )
    rho = spearman(pairs, ["window"], "_a", "_b")
    return rho.select("window", F.coalesce("rho", lit(1)).alias("rho"))


def rho_summary(rho: DataFrame) -> DataFrame:
    return rho.agg(F.avg("rho").alias("mean_rho"), F.stddev_pop("rho").alias("sd_rho"), F.count(F.lit(1)).alias("n_pairs"))


def windows_kendall_w(windows: DataFrame) -> DataFrame:
    """Concordance of the windows about the criteria; ordinal ranks, ties by criterion code."""
    w = Window.partitionBy("window").orderBy(score_key(F.col("weight")), F.col("criterion"))
    sums = windows.withColumn("_r", F.row_number().over(w)).groupBy("criterion").agg(
        F.sum("_r").cast("double").alias("_sum"), F.count(F.lit(1)).cast("double").alias("_k")
    )
    agg = sums.agg(F.var_pop("_sum").alias("_v"), F.count(F.lit(1)).cast("double").alias("_n"), F.max("_k").alias("_k"))
    n, k = F.col("_n"), F.col("_k")
    w_value = ratio(lit(12) * F.col("_v") * n, k * k * (n * n * n - n))
    return agg.select(
        k.cast("long").alias("n_windows"),
        F.when(k < 2, lit(1)).otherwise(F.coalesce(clip(w_value, 0, 1), lit(1))).alias("kendall_w"),
    )


def variation(weights: DataFrame) -> DataFrame:
    """Coefficient of variation of each criterion weight over the periods (ddof 0)."""
    mean = F.avg("weight")
    return weights.groupBy("criterion").agg(
        mean.alias("mean"),
        F.stddev_pop("weight").alias("sd"),
        F.when(mean < 1e-10, lit(0)).otherwise(ratio(F.stddev_pop("weight"), mean)).alias("cv"),
    )


def criterion_consistency(scores: DataFrame, composite: DataFrame) -> DataFrame:
    """``(period, criterion, rho)``: Spearman of the mean criterion score with the composite."""
    means = scores.groupBy(PERIOD, ENTITY, "criterion").agg(score_key(F.avg("score")).alias("_m"))
    both = settle(means.join(composite.select(PERIOD, ENTITY, score_key(F.col("composite")).alias("_c")), [PERIOD, ENTITY]))
    return spearman(both, [PERIOD, "criterion"], "_m", "_c")


def perturbed(
    weights: DataFrame, seed: int, replicates: int = 50, tiers: Mapping[str, float] = TIERS
) -> DataFrame:
    """``(tier, replicate, fit, criterion, weight, delta, moved)``: each weight times
    1 + uniform noise, renormalised. The noise is a hash of its keys."""
    cells = F.array(*[F.struct(F.lit(t).alias("tier"), lit(e).alias("_eps")) for t, e in tiers.items()])
    rows = weights.select("fit", "criterion", "weight", F.inline(cells)).withColumn(
        "replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    )
    u = uniform(seed, F.col("tier"), F.col("replicate"), F.col("fit"), F.col("criterion"))
    raw = rows.withColumn("_raw", F.col("weight") * (1 + F.col("_eps") * (2 * u - 1)))
    whole = F.sum("_raw").over(Window.partitionBy("tier", "replicate", "fit"))
    return raw.select(
        "tier",
        "replicate",
        "fit",
        "criterion",
        "weight",
        F.abs(F.col("_raw") - F.col("weight")).alias("delta"),
        ratio(F.col("_raw"), whole).alias("moved"),
    )


def weight_sensitivity(
    weights: DataFrame,
    seed: int,
    replicates: int = 50,
    tiers: Mapping[str, float] = TIERS,
    threshold: float = 0.1,
    compat: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Three-tier perturbation of the criterion weights of every period.

    Returns a table per tier (robustness, mean/sd/min/max/q95 of the disruption and
    of the weight change) and a table per (tier, criterion) with the share of
    replicates in which its rank moved. Periods with equal weights are skipped.

    ``compat`` compares sorting permutations in place of ranks, as some
    published figures do. Groups are one period's criteria, so windows are small.
    """
    flat = weights.groupBy("fit").agg(F.max("weight").alias("_hi"), F.min("weight").alias("_lo"))
    varied = flat.where(F.col("_hi") - F.col("_lo") > 1e-8).select("fit")
    rows = perturbed(weights.join(varied, "fit", "left_semi"), seed, replicates, tiers)
    keys = ["tier", "replicate", "fit"]
    base = Window.partitionBy(*keys)
    code = F.row_number().over(base.orderBy("criterion"))
    before = F.row_number().over(base.orderBy("weight", "criterion"))
    after = F.row_number().over(base.orderBy("moved", "criterion"))
    placed = rows.withColumns({"_before": before, "_after": after, "_code": code})
    if compat:
        # position -> which criterion stands there, before and after
        first = placed.select(*keys, F.col("_before").alias("_slot"), F.col("_code").cast("double").alias("_a"))
        second = placed.select(*keys, F.col("_after").alias("_slot"), F.col("_code").cast("double").alias("_b"))
        pairs = first.join(second, [*keys, "_slot"])
        rho_rows = pairs
        changes = pairs.select(*keys, F.col("_slot").alias("_code"), (F.col("_a") != F.col("_b")).alias("_changed"))
        changes = changes.join(placed.select(*keys, "_code", "criterion"), [*keys, "_code"])
    else:
        rho_rows = placed.select(*keys, F.col("_before").cast("double").alias("_a"), F.col("_after").cast("double").alias("_b"))
        changes = placed.select(*keys, "criterion", (F.col("_before") != F.col("_after")).alias("_changed"))
    rho = rho_rows.groupBy(*keys).agg(pearson("_a", "_b").alias("_rho"))
    disruption = clip(1 - F.coalesce(F.col("_rho"), lit(1)), 0, 1)
    delta = rows.groupBy(*keys).agg(F.avg("delta").alias("delta"))
    runs = settle(rho.select(*keys, disruption.alias("disruption")).join(delta, keys))
    n_periods = weights.agg(F.count_distinct("fit")).scalar()

    def stats(c: str):
        return [
            F.avg(c).alias(f"mean_{c}"),
            F.stddev_pop(c).alias(f"sd_{c}"),
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            # one row per replicate and period
            F.percentile(c, F.lit(0.95)).alias(f"q95_{c}"),
        ]

    per_tier = runs.groupBy("tier").agg(
        F.avg((F.col("disruption") <= threshold).cast("double")).alias("robustness"),
        *stats("disruption"),
        *stats("delta"),
        F.count(F.lit(1)).alias("n_runs"),
    )
    moves = changes.groupBy("tier", "criterion").agg(F.sum(F.col("_changed").cast("long")).alias("_moved"))
    per_criterion = moves.select(
        "tier", "criterion", (F.col("_moved") / (n_periods * replicates).cast("double")).alias("sensitivity")
    )
    return per_tier, per_criterion


def most_sensitive(per_criterion: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("tier").orderBy(F.col("sensitivity").desc(), F.col("criterion"))
    return per_criterion.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def criterion_sensitivity(
    means: DataFrame, seed: int, replicates: int = 50, spread: float = 0.15
) -> DataFrame:
    """1 - Spearman between a criterion's mean scores and the same with uniform noise,
    averaged over the replicates and scaled by the largest, per period."""
    # the ranks without noise are those of every replicate
    base = means.withColumn("_x", score_key(F.col("mean"))).where(F.col("_x").isNotNull())
    base = add_ranks(settle(base), [PERIOD, "criterion"], {"_ra": ("_x", True, "average")})
    base = settle(base.select(PERIOD, "criterion", ENTITY, "mean", "_ra"))
    rows = base.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).select(
        PERIOD,
        "criterion",
        "replicate",
        "_ra",
        F.greatest(
            F.col("mean")
            + spread * (2 * uniform(seed, F.col(PERIOD), F.col("criterion"), F.col(ENTITY), F.col("replicate")) - 1),
            lit(0),
        ).alias("_y"),
    )
    group = [PERIOD, "criterion", "replicate"]
    biggest = largest_group(base, group[:2])
    ranked = add_ranks(rows, group, {"_rb": ("_y", True, "average")}, biggest=biggest)
    rho = ranked.groupBy(*group).agg(pearson("_ra", "_rb").alias("rho"))
    loss = rho.groupBy(PERIOD, "criterion").agg(
        F.avg(1 - F.greatest(F.coalesce("rho", lit(0)), lit(0))).alias("_loss")
    )
    top = F.max("_loss").over(Window.partitionBy(PERIOD))
    return loss.select(
        PERIOD, "criterion", F.when(top > 0, ratio(F.col("_loss"), top)).otherwise(F.col("_loss")).alias("sensitivity")
    )


def key_weight_sensitivity(weights: DataFrame, seed: int, spread: float = 0.15, draws: int = 100) -> DataFrame:
    """Mean |delta| x weight per key over uniform draws, scaled by the largest."""
    rows = weights.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    d = F.abs(spread * (2 * uniform(seed, F.col("fit"), F.col("criterion"), F.col("draw")) - 1))
    mean = rows.groupBy("fit", "criterion").agg(F.avg(d * F.col("weight")).alias("_m"))
    top = F.max("_m").over(Window.partitionBy("fit"))
    return mean.select("fit", "criterion", F.when(top > 0, ratio(F.col("_m"), top)).otherwise(F.col("_m")).alias("sensitivity"))


def robustness(sensitivity: DataFrame, consistency: DataFrame) -> DataFrame:
    """Per period: mean of (1 - mean sensitivity) and (0.5 * mean rho + 0.5), each in [0, 1]."""
    a = sensitivity.groupBy(PERIOD).agg(clip(1 - F.avg("sensitivity"), 0, 1).alias("_a"))
    b = consistency.groupBy(PERIOD).agg(clip(F.avg("rho") * 0.5 + 0.5, 0, 1).alias("_b"))
    return a.join(b, PERIOD).select(PERIOD, ((F.col("_a") + F.col("_b")) / 2).alias("robustness"))


def scenario_weights(weights: DataFrame, seed: int, scenarios: int, spread: float = 0.15) -> DataFrame:
    """``(scenario, criterion, w)`` around one set of criterion weights."""
    rows = weights.withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(scenarios))))
    u = uniform(seed, F.col("scenario"), F.col("criterion"))
    return rows.select("scenario", "criterion", (F.col("weight") * (1 + spread * (2 * u - 1))).alias("w"))


def wide_composites(means: DataFrame, criteria: Sequence[str]) -> DataFrame:
    """One row per (period, entity) with the criterion means as columns."""
    return means.groupBy(PERIOD, ENTITY).agg(
        *[F.max(F.when(F.col("criterion") == k, F.col("mean"))).alias(k) for k in criteria]
    )


def scenario_stability(reweighed: DataFrame, base: DataFrame, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Spearman of every scenario's composite with the base composite per period, and
    the share of scenarios above the threshold."""
    both = settle(
        reweighed.select("scenario", PERIOD, ENTITY, score_key(F.col("composite")).alias("_a")).join(
            base.select(PERIOD, ENTITY, score_key(F.col("composite")).alias("_b")), [PERIOD, ENTITY]
        )
    )
    rho = settle(spearman(both, ["scenario", PERIOD], "_a", "_b"))
    share = rho.groupBy(PERIOD).agg(
        F.avg((F.col("rho") > threshold).cast("double")).alias("share_stable"), F.avg("rho").alias("mean_rho")
    )
    return rho, share


def rank_uncertainty(reweighed: DataFrame, k: int = 10) -> DataFrame:
    """Rank over the scenarios per entity: mean, sd, CV, range, P(first), P(top k), stability."""
    per = settle(
        reweighed.groupBy(PERIOD, ENTITY).agg(
            F.avg("rank").alias("mean_rank"),
            F.stddev_pop("rank").alias("sd_rank"),
            (F.max("rank") - F.min("rank")).alias("rank_range"),
            F.avg((F.col("rank") == 1).cast("double")).alias("p_first"),
            F.avg((F.col("rank") <= k).cast("double")).alias("p_top"),
        )
    )
    top = settle(per.groupBy(PERIOD).agg(F.max("sd_rank").alias("_top")))
    return per.join(top, PERIOD).select(
        PERIOD,
        ENTITY,
        "mean_rank",
        "sd_rank",
        F.coalesce(ratio(F.col("sd_rank"), F.col("mean_rank")), lit(0)).alias("cv_rank"),
        "rank_range",
        "p_first",
        "p_top",
        (1 - F.col("sd_rank") / (F.col("_top") + 1e-12)).alias("stability"),
    )


def win_rates(reweighed: DataFrame, focus: DataFrame) -> DataFrame:
    """Share of scenarios in which a focus entity ranks above another one of its period.

    ``focus``: a few ``(period, entity)`` rows per period, such as the leaders."""
    rows = reweighed.select("scenario", PERIOD, ENTITY, "rank")
    mine = settle(rows.join(focus, [PERIOD, ENTITY], "left_semi"))
    a = mine.select("scenario", PERIOD, F.col(ENTITY).alias("a"), F.col("rank").alias("_ra"))
    b = rows.select("scenario", PERIOD, F.col(ENTITY).alias("b"), F.col("rank").alias("_rb"))
    return (
        b.join(a, ["scenario", PERIOD]).where(F.col("a") != F.col("b"))
        .groupBy(PERIOD, "a", "b")
        .agg(F.avg((F.col("_ra") < F.col("_rb")).cast("double")).alias("win_rate"))
    )


def ranks_of(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return add_ranks(df, group, {"rank": (value, True, "truncated")})
