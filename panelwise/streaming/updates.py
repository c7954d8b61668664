"""Structured Streaming: forecasts with their truths arrive period by period.

Both jobs keep their state as versioned tables in a shared folder, one version per
micro-batch. A batch that runs again reads the same previous version and overwrites
its own, so a lost executor or driver does not count a batch twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from panelwise.functions.guards import lit
from panelwise.functions.relative_cells import ERROR, upper_end
from panelwise.operators.adaptive import residual_histogram
from panelwise.operators.evaluate import known
from panelwise.operators.stacking import update_weights


def _version(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{folder}/version-{batch}")
    except AnalysisException:
        return None


def _previous(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    for b in range(batch - 1, -1, -1):
        found = _version(spark, folder, b)
        if found is not None:
            return found
    return None


def equal_weights(forecasts: DataFrame, models: Sequence[str]) -> DataFrame:
    rows = forecasts.select("component").distinct()
    return rows.select("component", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), lit(1 / len(models)).alias("weight"))


def update_weights_stream(
    forecasts: DataFrame, folder: str, checkpoint: str, models: Sequence[str], gamma: float = 0.3
) -> StreamingQuery:
    """Blend the ensemble weights with the weights of every new batch of
    ``(entity, period, component, model, y, yhat)``."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _previous(spark, folder, number)
        if old is None:
            old = equal_weights(batch, models)
        new = update_weights(known(batch), old, models, gamma)
        new.write.mode("overwrite").parquet(f"{folder}/version-{number}")

    return (
        forecasts.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def adaptive_widths_stream(
    forecasts: DataFrame, folder: str, checkpoint: str, group: Sequence[str], alpha: float = 0.1, gamma: float = 0.05,
    error: float = ERROR,
) -> StreamingQuery:
    """Adaptive half-widths kept up to date: the state is a histogram of absolute
    residuals and the current alpha per group."""
    group = list(group)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _previous(spark, folder, number)
        fresh = residual_histogram(batch, group, error).groupBy(*group, "cell").agg(F.sum("n").alias("n"))
        if old is None:
            state = fresh.withColumn("alpha_t", lit(alpha))
        else:
            state = _advance(old, fresh, group, alpha, gamma, error)
        state.write.mode("overwrite").parquet(f"{folder}/version-{number}")

    return (
        forecasts.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _advance(old: DataFrame, fresh: DataFrame, group: list[str], alpha: float, gamma: float, error: float) -> DataFrame:
    """New histogram, and alpha moved by the share the current width misses."""
    now = widths(old, group, error).withColumnRenamed("cell", "_at")
    missed = fresh.join(now, group).groupBy(*group).agg(
        (F.sum(F.when(F.col("cell") > F.col("_at"), F.col("n")).otherwise(F.lit(0))) / F.sum("n")).alias("_miss"),
        F.first("alpha_t").alias("_a"),
    )
    moved = missed.select(*group, F.least(F.greatest(F.col("_a") + gamma * (alpha - F.col("_miss")), lit(0.001)), lit(0.999)).alias("alpha_t"))
    hist = old.select(*group, "cell", "n").unionByName(fresh.select(*group, "cell", "n")).groupBy(*group, "cell").agg(F.sum("n").alias("n"))
    kept = old.groupBy(*group).agg(F.first("alpha_t").alias("_old"))
    return hist.join(kept, group, "left").join(moved, group, "left").select(
        *group, "cell", "n", F.coalesce("alpha_t", "_old", lit(alpha)).alias("alpha_t")
    )


def widths(state: DataFrame, group: Sequence[str], error: float = ERROR) -> DataFrame:
    """``(group.., alpha_t, cell, half_width)`` of a state: a running count over at most
    one row per cell that occurs."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("n").over(Window.partitionBy(*group))
    rank = F.least(F.ceil(F.round((1 - F.col("alpha_t")) * (whole + 1), 9)), whole)
    placed = state.withColumns({"_c": F.sum("n").over(w), "_rank": rank})
    return placed.where(F.col("_c") >= F.col("_rank")).groupBy(*group).agg(
        F.first("alpha_t").alias("alpha_t"), F.min("cell").alias("cell"), upper_end(F.min("cell"), error).alias("half_width")
    )


def latest(spark: SparkSession, folder: str, batches: int = 1_000_000) -> DataFrame:
    """The newest state in a folder."""
    found, b = None, 0
    while b < batches:
        nxt = _version(spark, folder, b)
        if nxt is None:
            break
        found, b = nxt, b + 1
    if found is None:
        raise ValueError(f"no state in {folder}")
    return found
