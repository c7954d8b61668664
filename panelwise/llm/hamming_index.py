"""Nearest neighbours by multi-index hashing of learned binary codes, ranked by true distances."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle, unit_vectors
from .tiled_cosine import matrix

WORD = 16
BLOCKS = "dim int, block long, ids binary, vectors binary"
FOUND = "query_id long, vec_id long, score double"


def learn_rotation(x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, directions): principal directions, turned so that signs lose least (iterative quantisation); at most 64 bits."""
    mean = x.mean(axis=0)
    y = x - mean
    bits = min(64, x.shape[1])
    axes = np.linalg.eigh(y.T @ y)[1][:, ::-1][:, :bits]
    y = y @ axes
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
        turn = (u @ v).T
    return mean, axes @ turn


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit code for each row: signs of its turned components."""
    signs = (x - model[0]) @ model[1] >= 0
    full = np.zeros((len(x), 64), bool)
    full[:, : signs.shape[1]] = signs
    return np.packbits(full, axis=1).view(">u8").ravel().astype(np.uint64)


def probes() -> tuple[np.ndarray, np.ndarray]:
    """All differences of a 16-bit substring, fewest bits first, and how many there are up to each number of bits."""
    every = np.arange(1 << WORD, dtype=np.uint32)
    bits = np.bitwise_count(every)
    return every[np.argsort(bits, kind="stable")], np.cumsum(np.bincount(bits))


class Index:
    """Codes of a block, each of their four substrings sorted into buckets."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.order, self.starts = [], []
        for part in self.substrings(code):
            self.order.append(np.argsort(part, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << WORD))]))
        self.differences, self.up_to = probes()

    @staticmethod
    def substrings(code: np.ndarray) -> list[np.ndarray]:
        return [((code >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int64) for s in (0, 16, 32, 48)]

    def within(self, query: np.uint64, radius: int) -> np.ndarray:
        """Rows whose code differs from ``query`` in at most ``radius`` bits.

        Pigeonhole: with radius 4 a + b, a code within it is within a in one of the first b + 1 substrings or within
        a - 1 in one of the others. All buckets of those are read, and the whole code is compared."""
        share, extra = divmod(radius, 4)
        hit = np.zeros(len(self.code), bool)
        for k, part in enumerate(self.substrings(np.array([query]))):
            near = share if k <= extra else share - 1
            if near < 0:
                continue
            buckets = self.differences[: self.up_to[min(near, WORD)]] ^ np.uint32(part[0])
            a, b = self.starts[k][buckets], self.starts[k][buckets + 1]
            full = b > a
            a, n = a[full], (b - a)[full]
            ends = np.cumsum(n)
            hit[self.order[k][np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.code[rows] ^ query) <= radius]


def blocks(vectors: DataFrame, group: Column, n: int) -> DataFrame:
    """Rows packed by (dim, block): ids and components as little-endian bytes, in runs of at most ``n`` rows."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, serial = None, 0
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            dims, group = held["dim"].to_numpy(), held["block"].to_numpy()
            while len(held):
                other = (dims != dims[0]) | (group != group[0])
                stop = min(n, int(np.argmax(other)) if other.any() else len(held))
                if stop == len(held) and stop < n:
                    break
                yield row(held.slice(0, stop), serial)
                serial, held, dims, group = serial + 1, held.slice(stop), dims[stop:], group[stop:]
        if held is not None and len(held):
            yield row(held, serial)

    def row(t: pa.Table, serial: int) -> pa.RecordBatch:
        ids, x = t["vec_id"].to_numpy(), matrix(t["embedding"].combine_chunks())
        cells = [[t["dim"][0].as_py()], [t["block"][0].as_py() << 20 | serial], [ids.tobytes()], [x.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["dim", "block", "ids", "vectors"])

    rows = vectors.select(F.size("embedding").alias("dim"), group.cast("long").alias("block"), "vec_id", "embedding")
    return rows.repartition("dim", "block").sortWithinPartitions("dim", "block", "vec_id").mapInArrow(collect, BLOCKS)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > 4 * k:
        near = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
        return near[np.lexsort((ids[near], scores[near]))[:k]]
    return np.lexsort((ids, scores))[:k]


def search(queries: DataFrame, data: DataFrame, models: dict, radii: dict[int, int], k: int) -> DataFrame:
    """The ``k`` nearest of each pair of blocks among codes within the radius: query_id, vec_id, score.

    Every block of queries meets every block of vectors of its dimension once; a task holds one pair at a time."""
    shared = queries.sparkSession.sparkContext.broadcast((models, radii))
    side = lambda df, n: df.select("dim", F.col("block").alias(f"block_{n}"), F.col("ids").alias(f"ids_{n}"), F.col("vectors").alias(f"vectors_{n}"))
    names = data.select("dim", F.col("block").alias("block_2")).join(queries.select("dim", F.col("block").alias("block_1")), "dim")
    pairs = names.join(side(queries, 1), ["dim", "block_1"]).join(side(data, 2), ["dim", "block_2"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, radii = shared.value
        for batch in batches:
            for r in range(len(batch)):
                dim = batch.column("dim")[r].as_py()
                ids, x = [np.frombuffer(batch.column(f"ids_{n}")[r].as_py(), np.int64) for n in (1, 2)], [np.frombuffer(batch.column(f"vectors_{n}")[r].as_py()).reshape(-1, dim) for n in (1, 2)]
                index = Index(codes(x[1], models[dim]))
                out: list[tuple] = []
                for name, vector, code in zip(ids[0], x[0], codes(x[0], models[dim]), strict=True):
                    rows = index.within(code, radii[dim])
                    rows = rows[ids[1][rows] != name]
                    scores = np.sqrt(np.square(x[1][rows] - vector).sum(axis=1))
                    top = best(ids[1][rows], scores, k)
                    out.append((np.full(len(top), name), ids[1][rows][top], scores[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return pairs.select("dim", "ids_1", "vectors_1", "ids_2", "vectors_2").mapInArrow(look, FOUND)


def first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, sample: int = 8192, probes_for_radius: int = 64, share: float = 0.98, block: int = 16384, query_block: int = 512
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row with ``is_query`` among all others, by
    Euclidean distance in double precision, ties to the smaller vec_id.

    Takes vec_id and embedding; others are ignored. Null, zero and non-finite vectors and null ids take no part; of
    rows that repeat a vec_id the smallest vector counts; vectors meet those of their dimension only. A query gets all
    candidates if there are fewer than ``k``.

    Codes are learned on about ``sample`` rows of each dimension, chosen by a hash of the id. The radius is the
    ``share`` quantile of the code distances between about ``probes_for_radius`` of those rows and their ``k`` nearest among ALL
    rows, so it follows the data at every size. Every row is indexed, in blocks of about ``block`` rows, which meet blocks of about ``query_block`` queries. A query
    with fewer than ``k`` codes in its radius is searched again with all codes.
    """
    usable = unit_vectors(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    usable = settle(usable.withColumn("dim", F.size("embedding")))
    sizes = {r["dim"]: r["count"] for r in usable.groupBy("dim").count().collect()}
    ticket = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = lambda most: F.coalesce(*[F.when(F.col("dim") == d, F.lit(most / n)) for d, n in sizes.items()], F.lit(0.0))
    drawn = usable.filter(ticket < limit(sample)).select("dim", "vec_id", "embedding").toPandas()
    models = {}
    for d, rows in drawn.groupby("dim"):
        models[int(d)] = learn_rotation(np.array(rows["embedding"].tolist(), float))
    for d in sizes:  # so few rows that none was drawn
        models.setdefault(d, (np.zeros(d), np.eye(d)[:, :64]))
    spread = lambda n, most: F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // most))))
    data = settle(blocks(usable, spread(sum(sizes.values()), block), block))
    trial = blocks(usable.filter(ticket < limit(probes_for_radius)), F.lit(0), 1024)
    near = first(search(trial, data, models, {d: 64 for d in sizes}, k), k)
    own = lambda name, code: usable.select(F.col("vec_id").alias(name), F.col("dim").alias(f"dim_{name}"), F.col("embedding").alias(code))
    both = near.join(own("query_id", "a"), "query_id").join(own("vec_id", "b"), "vec_id").select(F.col("dim_vec_id").alias("dim"), "a", "b").toPandas()
    radii = {d: 64 for d in sizes}
    for d, rows in both.groupby("dim"):
        x, y = (codes(np.array(rows[c].tolist(), float), models[int(d)]) for c in "ab")
        radii[int(d)] = int(np.ceil(np.quantile(np.bitwise_count(x ^ y), share)))
    asked = usable.filter(is_query)
    asked_blocks = lambda df: blocks(df, spread(df.count(), query_block), query_block)
    found = settle(first(search(asked_blocks(asked), data, models, radii, k), k))
    had = found.groupBy("query_id").count()
    full = F.coalesce(*[F.when(F.col("dim") == d, F.lit(min(k, n - 1))) for d, n in sizes.items()], F.lit(0))
    short = asked.join(had, asked["vec_id"] == had["query_id"], "left").filter(F.coalesce("count", F.lit(0)) < full).select("vec_id", "embedding")
    short = settle(short)
    more = first(search(asked_blocks(short), data, models, {d: 64 for d in sizes}, k), k)
    kept = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return kept.unionByName(more).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
