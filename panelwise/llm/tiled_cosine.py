"""Near-duplicate vectors: tiles compared in the order of their principal components, with early stopping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import connected, settle, unit_vectors

TILE = 2048
#: Room for rounding in a bound; what it lets through is decided on the original vectors.
SLACK = 1e-9
TILES = "label long, dim int, tile long, low double, high double, ids binary, sizes binary, vectors binary"


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimension: axes (columns), largest variance first, from sums of products over all unit vectors."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                x = matrix(batch.column("values").filter(pa.array(dims == d)))
                x = np.column_stack([np.ones(len(x)), x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)])
                total[d] = total.get(d, 0) + x.T @ x
        for d, s in total.items():
            n = s.size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(s.ravel())], names=["dim", "cell", "x"])

    out: dict[int, np.ndarray] = {}
    cells = vectors.select("dim", "values").mapInArrow(sums, "dim int, cell int, x double").groupBy("dim", "cell").agg(F.sum("x").alias("x"))
    for d, own in cells.toPandas().groupby("dim"):  # (d + 1) ** 2 numbers for a dimension
        s = own.sort_values("cell")["x"].to_numpy().reshape(d + 1, d + 1)
        n, mean = s[0, 0], s[0, 1:] / s[0, 0]
        out[int(d)] = np.linalg.eigh(s[1:, 1:] / n - np.outer(mean, mean))[1][:, ::-1].copy()
    return out


def normed(x: np.ndarray) -> np.ndarray:
    """Unit vectors, also for components whose squares would overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with cosine(x[i], y[j]) >= threshold; i < j if both are the ``same`` tile."""
    ux, uy = normed(x), normed(y)
    px, py = ux @ axes, uy @ axes
    dims = x.shape[1]
    stops = sorted({max(1, dims // 4), max(1, dims // 2), max(1, 3 * dims // 4), dims})
    tails = lambda p: np.sqrt(np.maximum(np.cumsum((p * p)[:, ::-1], axis=1)[:, ::-1], 0))  # noqa: E731  norm from a dimension on
    tx, ty = tails(px), tails(py)
    rest = lambda t, s: t[:, s] if s < dims else np.zeros(len(t))
    left, right = [], []
    for a in range(0, len(x), 512):
        s = stops[0]
        part = px[a : a + 512, :s] @ py[:, :s].T
        i, j = np.nonzero(part + np.outer(rest(tx, s)[a : a + 512], rest(ty, s)) >= threshold - SLACK)
        dot, i = part[i, j], i + a
        if same:
            keep = i < j
            i, j, dot = i[keep], j[keep], dot[keep]
        for before, s in zip(stops, stops[1:], strict=False):
            if not len(i):
                break
            keep = np.zeros(len(i), bool)
            for b in range(0, len(i), 1 << 17):
                c = slice(b, b + (1 << 17))
                dot[c] += np.einsum("ij,ij->i", px[i[c], before:s], py[j[c], before:s])
                keep[c] = dot[c] + rest(tx, s)[i[c]] * rest(ty, s)[j[c]] >= threshold - SLACK
            i, j, dot = i[keep], j[keep], dot[keep]
        for b in range(0, len(i), 1 << 17):
            m, n = i[b : b + (1 << 17)], j[b : b + (1 << 17)]
            sure = np.einsum("ij,ij->i", ux[m], uy[n]) >= threshold
            left.append(m[sure])
            right.append(n[sure])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component under links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def cosine_links(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """Links of distinct vectors (``id``, ``label``, ``dim``, ``size``, ``values``) of equal label and dimension:
    (a, b, linked); ``linked`` counts the rows of the vectors linked with ``a``, each pair once on either side; (a, b)
    are a spanning forest of the links, with at most one row for each vector and pair of tiles.

    A tile holds at most ``tile`` vectors that follow each other on the first principal axis. Two tiles meet only if
    their intervals there are near enough: unit vectors with cosine t are sqrt(2 - 2 t) apart at most."""
    axes = vectors.sparkSession.sparkContext.broadcast(principal_axes(vectors))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, lead = batch.column("dim").to_numpy(), np.zeros(len(batch))
            for d in np.unique(dims).tolist():
                lead[dims == d] = normed(matrix(batch.column("values").filter(pa.array(dims == d)))) @ axes.value[d][:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead)], names=[*batch.schema.names, "lead"])

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while True:
                group = np.stack([table["label"].to_numpy(), table["dim"].to_numpy()], axis=1)
                other = (group != group[0]).any(axis=1) if len(group) else np.zeros(0, bool)
                stop = min(tile, int(np.argmax(other)) if other.any() else len(table))
                if stop == len(table) and stop < tile:
                    break
                yield row(table.slice(0, stop), part << 32 | number)
                number, table = number + 1, table.slice(stop)
                if not len(table):
                    break
            held = table if len(table) else None
        if held is not None:
            yield row(held, part << 32 | number)

    def row(t: pa.Table, number: int) -> pa.RecordBatch:
        lead = t["lead"].to_numpy()
        cells = [t["label"][0].as_py(), t["dim"][0].as_py(), number, float(lead.min()), float(lead.max())]
        cells += [t["id"].to_numpy().tobytes(), t["size"].to_numpy().tobytes(), matrix(t["values"].combine_chunks()).tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[f.split()[0] for f in TILES.split(", ")])

    columns = ["label", "dim", "id", "size", "values"]
    lead = vectors.select(*columns).mapInArrow(ordered, "label long, dim int, id long, size long, values array<double>, lead double")
    sorted_ = lead.repartitionByRange("label", "dim", "lead").sortWithinPartitions("label", "dim", "lead", "id")
    made = settle(sorted_.mapInArrow(tiles, TILES))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK)
    meta = made.select("label", "dim", "tile", "low", "high")
    a, b = meta.alias("a"), meta.alias("b")
    near = (F.col("b.low") - F.col("a.high") <= reach) & (F.col("a.low") - F.col("b.high") <= reach)
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & (F.col("a.tile") <= F.col("b.tile")) & near)
    pairs = pairs.select(F.col("a.tile").alias("one"), F.col("b.tile").alias("two"))
    side = lambda n, key: made.select(F.col("tile").alias(key), F.col("dim").alias(f"dim_{n}"), F.col("ids").alias(f"ids_{n}"), F.col("sizes").alias(f"sizes_{n}"), F.col("vectors").alias(f"vectors_{n}"))
    met = pairs.join(side(1, "one"), "one").join(side(2, "two"), "two")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                get = lambda name, kind, r=r, batch=batch: np.frombuffer(batch.column(name)[r].as_py(), kind)
                ids, sizes = [get(f"ids_{n}", np.int64) for n in (1, 2)], [get(f"sizes_{n}", np.int64) for n in (1, 2)]
                dim, same = batch.column("dim_1")[r].as_py(), batch.column("one")[r] == batch.column("two")[r]
                x, y = (get(f"vectors_{n}", np.float64).reshape(-1, dim) for n in (1, 2))
                i, j = tile_links(x, y, axes.value[dim], threshold, same)
                j = j if same else j + len(x)
                names, size = (ids[0], sizes[0]) if same else (np.concatenate(ids), np.concatenate(sizes))
                linked = np.bincount(i, size[j], len(names)) + np.bincount(j, size[i], len(names))
                root = forest(len(names), i, j)
                rows = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(names[rows]), pa.array(names[root[rows]]), pa.array(linked[rows].astype(np.int64))], names=["a", "b", "linked"])

    return met.select("one", "two", "dim_1", "ids_1", "sizes_1", "vectors_1", "ids_2", "sizes_2", "vectors_2").mapInArrow(compare, "a long, b long, linked long")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row, by cosine >= ``threshold`` between rows of equal, non-null label.

    Takes columns vec_id, embedding, label; others are ignored. Null, zero and non-finite vectors and rows without a
    label or vec_id link with nothing: n_links 0, their own component, kept. Vectors of different dimension link with
    nothing either. Equal vectors of a label are one class: each row links with the others of its class and with all
    rows of the classes linked with it. Rows that repeat a vec_id are rows of their own.
    """
    usable = unit_vectors(vectors).filter(F.col("label").isNotNull())
    usable = usable.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").alias("values"))
    classes = settle(
        usable.groupBy("label", "values")
        .agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
        .withColumns({"id": F.xxhash64("label", "values"), "dim": F.size("values")})
    )
    found = settle(cosine_links(classes, threshold, tile))
    counts = found.groupBy("a").agg(F.sum("linked").alias("linked"))
    roots = settle(connected(found.select("a", "b")))
    named = (
        classes.join(counts, classes["id"] == counts["a"], "left")
        .join(roots, classes["id"] == roots["node"], "left")
        .select("label", "values", "least", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    )
    known = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    linked = usable.join(known, ["label", "values"]).select("vec_id", "n_links", "component_id")
    whole = vectors.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("values"))
    valid = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("values").isNotNull()
    valid &= F.coalesce(F.forall("values", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    valid &= F.coalesce(F.exists("values", lambda x: x != 0), F.lit(False))
    alone = whole.filter(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
