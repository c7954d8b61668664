"""Walk-forward splits as tables and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from panelwise.operators.ordered import group_quantiles
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle


def fold_table(df: DataFrame, period: str = PERIOD, min_train: int = 8, max_folds: int = 5) -> DataFrame:
    """``(fold, val_period)``: validate on one period, train on all earlier ones.

    One row per period goes through the window. The first validation period is at
    least ``min_train`` periods in, or the last period."""
    periods = df.groupBy(period).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(F.lit(0)).orderBy(period)
    placed = periods.select(
        F.col(period).alias("val_period"),
        (F.row_number().over(w) - 1).alias("_i"),
        F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("_n"),
    )
    first = F.least(F.lit(min_train), F.col("_n") - 1)
    fold = F.col("_i") - first
    return settle(
        placed.where((F.col("_n") >= 2) & (fold >= 0) & (fold < max_folds)).select(fold.cast("int").alias("fold"), "val_period")
    )


def walk_forward(
    df: DataFrame, period: str = PERIOD, min_train: int = 8, max_folds: int = 5, never_validate: str | None = None
) -> DataFrame:
    """Rows tagged ``(fold, role)``; a row appears once per fold it takes part in.

    ``never_validate``: a flag column (generated rows) that keeps a row out of validation."""
    folds = fold_table(df, period, min_train, max_folds)
    role = F.when(F.col(period) == F.col("val_period"), F.lit("validate")).otherwise(F.lit("train"))
    table = F.array_sort(F.collect_list(F.struct("fold", "val_period")))
    # the folds are a handful of literals carried by every row: no join, no shuffle
    tagged = df.withColumn("_f", F.explode(folds.agg(table).scalar())).select(*df.columns, "_f.*")
    kept = tagged.where(F.col(period) <= F.col("val_period")).withColumn("role", role)
    if never_validate:
        kept = kept.where((F.col("role") == "train") | ~F.col(never_validate))
    return kept


def split_sizes(tagged: DataFrame) -> DataFrame:
    return tagged.groupBy("fold", "val_period").agg(
        F.sum((F.col("role") == "train").cast("long")).alias("n_train"),
        F.sum((F.col("role") == "validate").cast("long")).alias("n_validate"),
    )


def position_split(df: DataFrame, n_splits: int = 5) -> DataFrame:
    """Split by position inside each entity: fold f trains on positions below its cut and
    validates on the next block; blocks are median length / (n_splits + 1) long."""
    w = Window.partitionBy(ENTITY).orderBy(PERIOD)
    lengths = settle(df.groupBy(ENTITY).agg(F.count(F.lit(1)).alias("n")))
    median = group_quantiles(lengths.withColumnRenamed("n", "_len"), [], "_len", {"median": 0.5})
    block = median.select(F.greatest(F.lit(1), F.floor(F.col("median") / (n_splits + 1))).cast("int")).scalar()
    placed = df.withColumns({"_pos": F.row_number().over(w) - 1, "_b": block})
    tagged = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    cut = (F.col("fold") + 1) * F.col("_b")
    role = F.when(F.col("_pos") < cut, F.lit("train")).when(F.col("_pos") < cut + F.col("_b"), F.lit("validate"))
    return tagged.withColumn("role", role).where(F.col("role").isNotNull()).drop("_pos", "_b")


def leave_one_out_errors(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Error of predicting each entity by the mean of the OTHER entities: sums minus own
    share, no model per entity."""
    per = settle(
        rows.groupBy(*group, ENTITY).agg(F.sum("y").alias("_s"), F.count("y").alias("_n"), F.sum(F.col("y") * F.col("y")).alias("_ss"))
    )
    whole = settle(per.groupBy(*group).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn")))
    both = per.join(whole, list(group))
    other = F.try_divide(F.col("_ts") - F.col("_s"), F.col("_tn") - F.col("_n"))
    mse = F.try_divide(F.col("_ss") - 2 * other * F.col("_s") + F.col("_n") * other * other, F.col("_n"))
    return both.select(*group, ENTITY, other.alias("yhat"), F.sqrt(F.greatest(mse, F.lit(0.0))).alias("rmse"))
