"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle

BUCKETS = 1 << 16


def fraction(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def thresholds(rate: Column) -> Column:
    """P(N <= k) for k = 0, 1, .. of a Poisson variable, so far that the rest is below the 52 bits of the fraction."""
    last = F.ceil(rate + F.sqrt(rate) * 12 + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["sums"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, unlisted: float = 0.0) -> DataFrame:
    """(source, size, rate, parts, sums): how often a document of each source is repeated on average.

    A source gets its share ``weight / all weights`` of ``epochs`` times the bytes of the corpus. Without ``weights``
    all sources weigh the same; with them, other sources (also null) weigh ``unlisted``. Rates above 500 are drawn
    as a sum of ``parts`` equal variables, so that no probability underflows."""
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) + 1
    sizes = docs.select(F.col("source").cast("string").alias("source"), size.cast("long").alias("size")).groupBy("source").agg(F.sum("size").alias("size"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        given = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else None
        weight = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(float(unlisted))) if weights else F.lit(float(unlisted))
    weighted = sizes.withColumn("weight", weight)
    totals = weighted.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    joined = weighted.withColumn("one", F.lit(1)).join(totals.withColumn("one", F.lit(1)), "one")
    share = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight")).otherwise(F.lit(0.0))
    rated = joined.withColumn("rate", F.lit(float(epochs)) * F.col("all_size") * share / F.col("size"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / 500).cast("int")))
    return rated.select("source", "size", "rate", "parts", thresholds(F.col("rate") / F.col("parts")).alias("sums"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, unlisted: float = 0.0, seed: int = 7, columns: list[Column] | None = None) -> DataFrame:
    """Every document as often as drawn, in a global random order: ``row`` (struct of ``columns``, all by default),
    ``rate``, ``copies``, ``copy`` (from 1) and ``position`` (from 0, gapless).

    ``copies`` inverts the Poisson distribution with the source's mean rate at a hash of seed and doc_id, so it
    depends neither on partitions nor on a task that runs twice; rows with equal doc_id (also null) and source are drawn alike and
    each kept. A null source is a source of its own; a null text has size 1. Order: MD5 of seed, doc_id and copy; equal
    rows in any order. Only built-in functions. The table of sources is written first, so that Spark knows its size: it
    broadcasts it below its own threshold, else a hot source is a skewed join that it splits. Rows are shuffled by buckets
    of the random order."""
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*(columns or ["*"])).alias("row"),
        id_.alias("_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        F.col("source").isNull().alias("_none"),
    )
    rates = settle(source_rates(docs, weights, epochs, unlisted)).select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), "rate", "parts", "sums")
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: fraction(F.lit(str(seed)), F.col("_id"), j.cast("string")))
    drawn = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter("sums", lambda s: s <= u)))
    counted = rows.join(rates, ["_source", "_none"]).select("row", "_id", "rate", drawn.alias("copies"))
    copied = counted.filter("copies > 0").select("row", "_id", "rate", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    ordered = copied.withColumn("_key", F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.col("_id"), F.col("copy").cast("string"))))
    ordered = ordered.withColumn("_bucket", F.conv(F.substring("_key", 1, 4), 16, 10).cast("int"))
    light = counted.select("_id", "copies").filter("copies > 0").select("_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), F.col("_id"), F.col("copy").cast("string")))
    sizes = light.groupBy(F.conv(F.substring(key, 1, 4), 16, 10).cast("int").alias("_bucket")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over at most 65,536 buckets
    firsts = sizes.select("_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_first"))
    within = Window.partitionBy("_bucket").orderBy("_key", "_id", "copy")
    return ordered.join(firsts, "_bucket").select(
        "row", "rate", "copies", "copy", (F.col("_first") + F.row_number().over(within) - 1).cast("long").alias("position")
    )


MIX_SQL = """
WITH facts AS (SELECT doc_id, source, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
sizes AS (SELECT source, sum(size) AS size FROM facts GROUP BY source),
rates AS (
  SELECT source, 1.0::DOUBLE * (SELECT sum(size) FROM sizes)::DOUBLE * (1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE) / size::DOUBLE AS rate
  FROM sizes),
split AS (SELECT *, greatest(1, ceil(rate / 500))::BIGINT AS parts FROM rates),
tables AS (
  SELECT *, list_transform(range(0, ceil(rate / parts + sqrt(rate / parts) * 12 + 41)::BIGINT),
    lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(rate / parts) - rate / parts - lgamma(j + 1))))) AS sums
  FROM split),
counted AS (
  SELECT f.doc_id, f.source, f.size, t.rate, list_sum(list_transform(range(1, t.parts + 1), lambda part: len(list_filter(t.sums, lambda s: s <=
    ('0x' || substr(md5('7|' || coalesce(f.doc_id::VARCHAR, '') || '|' || part::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE))))::BIGINT AS copies
  FROM facts f JOIN tables t ON f.source IS NOT DISTINCT FROM t.source),
copied AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM counted WHERE copies > 0)
SELECT doc_id, source, size, round(rate, 6) AS rate, copies::BIGINT AS copies, copy::BIGINT AS copy,
  row_number() OVER (ORDER BY md5('order 7|' || coalesce(doc_id::VARCHAR, '') || '|' || copy::VARCHAR), coalesce(doc_id::VARCHAR, ''), copy) - 1 AS position
FROM copied
"""
