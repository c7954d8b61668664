"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwise.session import settle, shared_folder

__all__ = ["ascii_lower", "connected", "documents", "embeddings", "numbered", "renamed", "settle", "shared_folder", "slices", "small_batches", "unit_vectors"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``most`` bytes in ``column``; a longer single row stays whole.

    Arrow's pool gives back what it no longer needs after each batch: a worker lives on through later stages."""
    for batch in batches:
        values = batch.column(column)
        if not len(values):
            continue
        widths = np.nan_to_num(np.asarray(pc.binary_length(values).to_numpy(zero_copy_only=False), float))
        ends = np.cumsum(widths)
        start = 0
        while start < len(values):
            before = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside send at most ``rows`` rows at a time to a worker: where a row holds several whole texts or sets, the
    default of 10,000 makes batches as large as all of them, in the executor and again in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str], list[str]]:
    """``docs`` with its columns named c0, c1, .. so that none can clash, those names, and the names of the ``wanted`` columns
    as strings: c0, c1, .. where they are strings already, so that a text is sent to a worker once, else a column of its own."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = {c.lower(): i for i, c in enumerate(docs.columns)}
    rows, found = docs.toDF(*names), []
    for c in wanted:
        i = place[c.lower()]
        found.append(names[i] if docs.dtypes[i][1] == "string" else f"as_{c}")
        if found[-1] != names[i]:
            rows = rows.withColumn(found[-1], F.col(names[i]).cast("string"))
    return rows, names, found


def renamed(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows of :func:`numbered`."""
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def unit_vectors(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """Rows whose vector takes part: not null, not zero, every component a finite number; components as doubles."""
    values = F.col(value).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(*[c for c in dict.fromkeys((key, "label")) if c in vectors.columns], values.alias(value)).filter(
        F.col(key).isNotNull() & F.col(value).isNotNull() & finite & F.exists(value, lambda x: x != 0)
    )


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph: (node, root), root the smallest node; nodes without an edge to another are left out.

    Large-star and small-star steps in turn (Kiveris et al. 2014) until the edges no longer change. A step is a
    minimum per node, combined before the shuffle, joined back to the edges, so that a node with very many
    neighbours is a skewed join that Spark splits. Every round is written to the shared folder, which cuts lineage.
    """
    links = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = settle(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
