"""Panels derived from transaction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise.panel import Hierarchy, Panel

SUPPLIER_HIERARCHY = Hierarchy(
    groups={
        "K1": ("I11", "I12", "I13"),
        "K2": ("I21", "I22"),
        "K3": ("I31", "I32"),
        "K4": ("I41", "I42"),
    },
    cost=frozenset({"I31", "I32", "I41", "I42"}),
)

CUSTOMER_HIERARCHY = Hierarchy(
    groups={"B1": ("J11", "J12"), "B2": ("J21", "J22"), "B3": ("J31",)}, cost=frozenset({"J31"})
)

USER_HIERARCHY = Hierarchy(groups={"E1": ("U11", "U12"), "E2": ("U21", "U22")}, cost=frozenset({"U22"}))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _mean(value, when=None):
    col = F.col(value) if when is None else F.when(when, F.col(value))
    return F.round(F.avg(col), 8)


def _share(condition):
    return F.round(F.avg(F.when(condition, 1.0).otherwise(0.0)), 8)


def supplier_panel(spark: SparkSession, folder: str, gaps: bool = True) -> Panel:
    """Supplier x year of shipping, nine indicators in four criteria.

    With ``gaps``: returns (K4) are tracked from 1997 on, I22 is discontinued
    from 2000 on, I31 is measured on small lines only and is missing where a
    supplier has none, and in 1999 suppliers without a bulk line did not report.
    """
    lines = table(spark, folder, "lineitem")
    small = F.col("l_quantity") <= 2
    agg = lines.groupBy(
        F.col("l_suppkey").cast("long").alias("entity"), F.year("l_shipdate").cast("int").alias("period")
    ).agg(
        F.round(F.sum("l_quantity"), 6).alias("I11"),
        F.count(F.lit(1)).cast("double").alias("I12"),
        _mean("l_quantity").alias("I13"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("I21"),
        _mean("l_extendedprice").alias("I22"),
        _mean("l_discount", small if gaps else None).alias("I31"),
        _mean("l_tax").alias("I32"),
        _share(F.col("l_returnflag") == "R").alias("I41"),
        _share(F.col("l_returnflag") == "A").alias("I42"),
        F.max("l_quantity").alias("_bulk"),
    )
    if gaps:
        silent = (F.col("period") == 1999) & (F.col("_bulk") < 49)
        rules = {
            "I22": F.col("period") >= 2000,
            "I41": F.col("period") < 1997,
            "I42": F.col("period") < 1997,
        }
        agg = agg.withColumns(
            {
                c: F.when(silent | rules[c] if c in rules else silent, None).otherwise(F.col(c))
                for c in SUPPLIER_HIERARCHY.indicators
            }
        )
    return Panel(agg.select("entity", "period", *SUPPLIER_HIERARCHY.indicators), SUPPLIER_HIERARCHY)


def customer_panel(spark: SparkSession, folder: str) -> Panel:
    """Customer x year of ordering; only customers that ordered that year have a row."""
    data = table(spark, folder, "orders").groupBy(
        F.col("o_custkey").cast("long").alias("entity"), F.year("o_orderdate").cast("int").alias("period")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("J11"),
        F.round(F.sum("o_totalprice"), 2).alias("J12"),
        _mean("o_totalprice").alias("J21"),
        F.max("o_totalprice").alias("J22"),
        _share(F.col("o_orderpriority") == "1-URGENT").alias("J31"),
    )
    return Panel(data, CUSTOMER_HIERARCHY)


def user_panel(spark: SparkSession, folder: str) -> Panel:
    """User x day of the event stream; the period is the day of the year 2024."""
    data = table(spark, folder, "events").groupBy(
        F.col("user_id").cast("long").alias("entity"), F.dayofyear("ts").cast("int").alias("period")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("U11"),
        F.round(F.sum("value"), 6).alias("U12"),
        _mean("value").alias("U21"),
        _share(F.col("event_type") == "error").alias("U22"),
    )
    return Panel(data, USER_HIERARCHY)
