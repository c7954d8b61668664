"""Shards of near equal bytes, tokens and rows by vector bin packing of groups."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import settle

#: A group with less than this share of a shard is packed with others of its bundle.
GRAIN = 1 / 1024
#: Bundles of small groups for each shard.
BUNDLES = 512
#: Rows of a unit are numbered in cells of about so many bytes, each in one task.
CELL_BYTES = 64 << 20


def place(items: np.ndarray, shards: int, tolerance: float = 0.0005) -> np.ndarray:
    """A shard for each item (rows of bytes, tokens, rows): largest items first, each where the dot product of its
    sizes with the residual capacity is highest among the shards that have room for its bytes; if none has, the one with most room."""
    total = np.maximum(items.sum(axis=0), 1e-12)
    need = items * (shards / total)
    room, out = np.ones((shards, items.shape[1])), np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -need.max(axis=1))):
        free = np.flatnonzero(room[:, 0] + tolerance >= need[i, 0])
        best = free[np.argmax(room[free] @ need[i])] if len(free) else np.argmax(room[:, 0])
        room[best] -= need[i]
        out[i] = best
    return out


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The rows of ``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Law ``bytes``: shards have near equal sizes, a row's size being the UTF-8 bytes of its text plus 1 (null text:
    none); tokens (words plus 1) and rows are balanced as far as that allows. Equal texts (null like empty) are a
    group and stay together, unless the group is larger than a shard, when it is cut by a hash of doc_id. Repeated rows
    and null doc_ids are kept. The two added columns replace columns of the same name.

    Groups above 1/1024 of a shard (at most 48 times 1024 times ``shards``) are packed one by one, all others in
    512 bundles a shard by a hash of the text; so the table of units on the driver is bounded whatever the input.
    Texts are shuffled once, by the cells that also number the rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = lambda df: df.withColumn("_group", F.xxhash64(text)).withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), F.lit(1)))
    plain = docs.select(F.struct("*").alias("_doc"), F.col("doc_id"), F.col("text"))
    facts = settle(
        keyed(docs.select("doc_id", "text")).select("_group", "_row", (F.octet_length(text) + 1).cast("long").alias("bytes"), (F.regexp_count(text, F.lit(r"\S+")) + 1).cast("long").alias("tokens"))
    )
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    names = ["bytes", "tokens", "rows"]
    whole = facts.agg(*sums).first()
    capacity = [max(1.0, (whole[n] or 0) / shards) for n in names]
    groups = facts.groupBy("_group").agg(*sums)
    large = F.greatest(*[F.col(n) / F.lit(c) for n, c in zip(names, capacity, strict=True)])
    heavy = groups.withColumn("share", large).filter(F.col("share") > GRAIN).select("_group", "share").toPandas()
    pieces = spark.createDataFrame(
        [(int(g), math.ceil(s * 64) if s > 1 else 1) for g, s in zip(heavy["_group"], heavy["share"], strict=True)], "_group long, pieces int"
    )
    bundle = F.pmod(F.xxhash64("_group", F.lit(2)), F.lit(BUNDLES * shards))
    parted = lambda df: (  # noqa: E731  the unit of a row; the table of large groups is bounded, see above
        df.join(F.broadcast(pieces), "_group", "left")
        .withColumn("unit", F.when(F.col("pieces").isNull(), bundle).otherwise(F.col("_group")))
        .withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod("_row", F.col("pieces")).cast("int")))
    )
    units = parted(facts).groupBy("unit", "piece").agg(*sums).toPandas().sort_values(["unit", "piece"])
    units["shard"] = place(units[names].to_numpy(float), shards) if len(units) else np.zeros(0, int)
    units = units.sort_values(["shard", "unit", "piece"])
    units["base"] = units.groupby("shard")["rows"].cumsum() - units["rows"]
    units["cells"] = np.maximum(1, np.ceil(units["bytes"] / CELL_BYTES)).astype(int) if len(units) else 0
    rows = [tuple(int(x) for x in r) for r in units[["unit", "piece", "shard", "base", "cells"]].itertuples(index=False)]
    table = F.broadcast(spark.createDataFrame(rows, "unit long, piece int, shard int, base long, cells int"))
    celled = lambda df: parted(df).join(table, ["unit", "piece"]).withColumn("cell", F.pmod(F.xxhash64("_row", F.lit(3)), F.col("cells")).cast("int"))
    counts = celled(facts).groupBy("unit", "piece", "cell").agg(F.count("*").alias("n"), F.first("base").alias("base"))
    before = Window.partitionBy("unit", "piece").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("unit", "piece", "cell", (F.col("base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("first"))
    within = Window.partitionBy("unit", "piece", "cell").orderBy("doc_id")
    numbered = celled(keyed(plain)).join(firsts, ["unit", "piece", "cell"]).withColumn("slot", F.col("first") + F.row_number().over(within) - 1)
    kept = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c.lower() not in ("shard", "slot")]
    return numbered.select(*kept, "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Write the rows as Parquet, a folder ``shard=N`` for each shard."""
    shard(docs, shards).write.partitionBy("shard").option("compression", "zstd").parquet(path)
