"""Gaps filled from the nearest entities of a period, without comparing all with all.

Distances leave out cells that either row lacks: the mean squared difference of the shared columns (in standard
deviations), times the number of columns. Rows of one period and one pattern of gaps are laid along a space-filling curve and
cut into blocks with a bounding box, so a box gives bounds of the distance in whatever columns two blocks share.
A block of rows to fill first meets the blocks nearest to it; the k-th distances found there rule out every block whose box
lies farther away, and only the others meet. Nothing is approximate: what is ruled out cannot hold a neighbour."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from panelwise.functions.guards import lit
from panelwise.panel import ENTITY, PERIOD
from panelwise.session import settle

#: Rows of a block at most; two blocks' distances are one array in a task.
BLOCK_ROWS = 512
#: Squared distances are compared on a grid of this many digits, ties by entity.
DIGITS = 9
BITS = 60


def curve(z: np.ndarray) -> np.ndarray:
    """Place of each row (standardised, NaN where missing) along a space-filling curve: the bits of its squashed coordinates,
    interleaved."""
    n, p = z.shape
    bits = max(1, BITS // p)
    squashed = 0.5 * (1 + z / (1 + np.abs(z)))
    cell = np.where(np.isnan(z), 0, np.minimum(squashed * (1 << bits), (1 << bits) - 1)).astype(np.int64)
    out = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for c in range(min(p, BITS)):
            out = out << 1 | (cell[:, c] >> b & 1)
    return out


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, p)


def blocks(rows: DataFrame, columns: Sequence[str], rows_per_block: int) -> DataFrame:
    """``(block, at, pattern, n, low, high, entities, periods, z)``: rows ``(entity, period, at, columns..)`` in blocks of one ``at`` and one pattern;
    boxes are NaN where the pattern has a gap."""
    p, key = len(columns), rows.schema[ENTITY].dataType
    plain = rows.select(ENTITY, PERIOD, "at", F.array(*[F.col(c).cast("double") for c in columns]).alias("z"))
    coded_schema = T.StructType([*[plain.schema[c] for c in (ENTITY, PERIOD, "at")], T.StructField("z", T.ArrayType(T.DoubleType())), T.StructField("pattern", T.StringType()), T.StructField("code", T.LongType())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _matrix(batch.column("z"), p)
            names = ["".join("01"[int(g)] for g in row) for row in np.isnan(z)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(curve(z))], names=[*batch.schema.names, "pattern", "code"])

    fields = [("block", T.LongType()), ("at", plain.schema["at"].dataType), ("pattern", T.StringType()), ("n", T.LongType()), ("low", T.ArrayType(T.DoubleType())), ("high", T.ArrayType(T.DoubleType())),
              ("entities", T.ArrayType(key)), ("periods", T.ArrayType(plain.schema[PERIOD].dataType)), ("z", T.ArrayType(T.DoubleType()))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _matrix(batch.column("z"), p)
            keys = list(zip(batch.column("at").to_pylist(), batch.column("pattern").to_pylist(), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for a, stop in zip(starts, [*starts[1:], len(keys)], strict=True):
                for b in range(a, stop, rows_per_block):
                    e = min(stop, b + rows_per_block)
                    part, take = z[b:e], batch.slice(b, e - b)
                    one = lambda x, t: pa.array([x], pa.list_(t))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([number]), take.column("at").slice(0, 1), pa.array([keys[a][1]]), pa.array([e - b]),
                        one(part.min(axis=0), pa.float64()), one(part.max(axis=0), pa.float64()), *[pa.ListArray.from_arrays(pa.array([0, e - b], pa.int32()), take.column(c)) for c in (ENTITY, PERIOD)],
                        one(part.ravel(), pa.float64()),
                    ], names=[name for name, _ in fields])
                    number += 1

    order = ["at", "pattern", "code", ENTITY]
    sorted_rows = plain.mapInArrow(code, coded_schema).repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(sorted_rows.mapInArrow(cut, T.StructType([T.StructField(n, t) for n, t in fields])))


def box_distances(pairs: DataFrame) -> DataFrame:
    """``(block, cell, n, cells, far)``: the columns that the cell can fill in the block, and the least squared distance of their boxes;
    pairs without a shared column, or without a column to fill, are left out."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = len(batch.column("pattern")[0].as_py())
            low, high, low_d, high_d = (_matrix(batch.column(c), p) for c in ("low", "high", "low_d", "high_d"))
            gap_q, gap_d = np.isnan(low), np.isnan(low_d)
            apart = np.where(gap_q | gap_d, 0.0, np.maximum(0, np.maximum(low_d - high, low - high_d)))
            shared = (~gap_q & ~gap_d).sum(axis=1)
            fills = gap_q & ~gap_d
            far = (apart**2).sum(axis=1) * p / np.maximum(shared, 1)
            keep = np.flatnonzero((shared > 0) & fills.any(axis=1))
            cells = pa.array([np.flatnonzero(fills[i]).tolist() for i in keep], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(keep)) for c in ("block", "cell", "n")], cells, pa.array(far[keep])], names=["block", "cell", "n", "cells", "far"])

    return pairs.mapInArrow(bound, "block long, cell long, n long, cells array<int>, far double")


def meet(pairs: DataFrame, queries: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``(block, row, column, d, entity, value)``: for each pair of blocks and each gap, the donors not farther than the k-th nearest
    that the block's task has seen so far; the k nearest of all pairs are among them."""
    entity = cells.schema["entities"].dataType.elementType
    own = queries.select("block", F.col("z").alias("q"), "pattern")
    others = cells.select(F.col("block").alias("cell"), F.col("z").alias("d"), F.col("entities"))
    wide = pairs.select("block", "cell").distinct().join(own, "block").join(others, "cell").repartition("block").sortWithinPartitions("block", "cell")
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("d", T.DoubleType()), T.StructField("entity", entity), T.StructField("value", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                p = len(one.column("pattern")[0].as_py())
                q, d = _matrix(one.column("q"), p), _matrix(one.column("d"), p)
                if one.column("block")[0].as_py() != block:
                    block, best = one.column("block")[0].as_py(), {}
                gap_q, gap_d = np.isnan(q[0]), np.isnan(d[0])
                both = np.flatnonzero(~gap_q & ~gap_d)
                far = np.zeros((len(q), len(d)))
                for c in both:
                    far += (q[:, c][:, None] - d[:, c][None]) ** 2
                far = np.round(far * p / max(len(both), 1), DIGITS)
                names = one.column("entities").flatten()
                by_name = np.asarray(pc.sort_indices(names))
                order = by_name[np.argsort(far[:, by_name], axis=1, kind="stable")[:, :k]]
                near = np.take_along_axis(far, order, axis=1)
                for c in np.flatnonzero(gap_q & ~gap_d):
                    known = best.get(c, np.full((len(q), k), np.inf))
                    row, place = np.nonzero(near <= known[:, -1:])
                    best[c] = np.sort(np.concatenate([known, near], axis=1), axis=1)[:, :k]
                    donor = order[row, place]
                    n = len(row)
                    if n:
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(n, block)), pa.array(row.astype(np.int32)), pa.array(np.full(n, c, np.int32)), pa.array(near[row, place]),
                            names.take(pa.array(donor)), pa.array(d[donor, c]),
                        ], names=schema.names)

    return wide.mapInArrow(compare, schema)


def nearest_entities(
    df: DataFrame, columns: Sequence[str], k: int = 5, donors: DataFrame | None = None, rows_per_block: int = BLOCK_ROWS, first: int = 2,
) -> DataFrame:
    """Every gap gets the mean of the column over the ``k`` nearest rows of the period that have it.

    Nearness: the squared differences of the columns that both rows have, each in standard deviations of the donors'
    column, summed and scaled to all columns; ties go to the smaller entity. Fewer than ``k`` donors give what they have; a gap without
    a donor that shares a column stays. ``donors``: rows to take from (default: ``df`` itself); a period that they do not
    have takes their nearest one, the earlier of two. ``rows_per_block`` and ``first`` (blocks that every block meets before any is
    ruled out) decide cost only. One row per entity and period is assumed."""
    columns, given = list(columns), df if donors is None else donors
    stats = given.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    sd = {c: stats[c] or 1.0 for c in columns}
    scaled = lambda table, at: table.select(ENTITY, PERIOD, at.alias("at"), *[(F.col(c) / lit(sd[c])).alias(c) for c in columns])
    cells = blocks(scaled(given, F.col(PERIOD)), columns, rows_per_block)
    gap = F.exists(F.array(*columns), lambda v: v.isNull())
    at = F.col(PERIOD)
    if donors is not None:
        known = sorted(r[0] for r in given.select(PERIOD).distinct().collect() if r[0] is not None)  # periods are few
        pairs = [F.struct(F.abs(F.col(PERIOD) - y).alias("far"), F.lit(y).alias("at")) for y in known]
        at = F.least(*pairs).getField("at") if len(pairs) > 1 else F.lit(known[0] if known else None)
    queries = blocks(scaled(df.filter(gap), at.cast(given.schema[PERIOD].dataType)), columns, rows_per_block)
    boxes = cells.select(F.col("block").alias("cell"), "at", "n", F.col("low").alias("low_d"), F.col("high").alias("high_d"))
    pairs = settle(box_distances(queries.select("block", "at", "pattern", "low", "high").join(boxes, "at")))
    flat = pairs.select("block", "cell", "n", "far", F.explode("cells").alias("column"))
    order = Window.partitionBy("block", "column").orderBy("far", "cell")
    turn = flat.withColumns({"place": F.row_number().over(order), "before": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")})
    chosen = settle(turn.filter((F.col("place") <= first) | (F.col("before") < k)).select("block", "cell").distinct())
    near = settle(meet(chosen, queries, cells, k))
    kth = _nearest(near, k).groupBy("block", "row", "column").agg(F.max("d").alias("d"), F.count("*").alias("n"))
    kth = kth.groupBy("block", "column").agg(F.max(F.when(F.col("n") < k, lit(float("inf"))).otherwise(F.col("d"))).alias("limit"))
    left = flat.join(chosen, ["block", "cell"], "left_anti").join(kth, ["block", "column"], "left")
    left = left.filter(F.col("limit").isNull() | (F.col("far") <= F.col("limit") + lit(10.0**-DIGITS)))
    found = _nearest(near.unionByName(meet(left, queries, cells, k)), k).groupBy("block", "row", "column").agg(F.avg("value").alias("value"))
    rows = queries.select("block", F.posexplode(F.arrays_zip("entities", "periods")).alias("row", "of"))
    values = [F.max(F.when(F.col("column") == i, F.col("value") * sd[c])).alias(f"_near_{c}") for i, c in enumerate(columns)]
    wide = found.join(rows, ["block", "row"]).groupBy(F.col("of.entities").alias(ENTITY), F.col("of.periods").alias(PERIOD)).agg(*values)
    filled = df.join(settle(wide), [ENTITY, PERIOD], "left")
    return filled.select(*[F.coalesce(c, f"_near_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("block", "row", "column").orderBy("d", "entity")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")
