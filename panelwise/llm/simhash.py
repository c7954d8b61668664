"""Near-duplicates by SimHash fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER_BYTES, connected, settle, slices

#: A bucket with more fingerprints is cut by more of their bits (until 14 bits are left, which bounds it).
BUCKET = 1 << 16
#: Fingerprints that share a key, on average; decides how many blocks there are, not what is found.
SHARED = 64


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all runs of ``words`` words, as a signed 64-bit number."""
    found = (text or b"").translate(LOWER_BYTES).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    starts, ends = starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist()
    set_ = np.zeros(64, np.int64)
    for i in range(0, len(starts), 1 << 16):
        some = [xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[i : i + (1 << 16)], ends[i : i + (1 << 16)], strict=True)]
        set_ += np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_ * 2 > len(starts)).tobytes(), "big", signed=True)


def row_hash() -> Column:
    """With doc_id, tells rows apart whose id is null or repeated."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("hash")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, hash (see :func:`row_hash`), fingerprint (signed 64 bits) of every text; a null text has no words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(x, words) for x in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), pa.array(found, pa.int64())], names=["doc_id", "hash", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id long, hash long, fingerprint long")


def masks(bits: list[int], distance: int, blocks: int) -> list[int]:
    """Two values that differ in at most ``distance`` of ``bits`` agree under one of these masks (signed 64 bits)."""
    edges = [round(i * len(bits) / blocks) for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
    out = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def block_count(n: int, distance: int) -> int:
    """Fewest blocks by which ``n`` even fingerprints share a key with ``SHARED`` others or fewer."""
    blocks = distance + 1
    while n / 2.0 ** (64 * (blocks - distance) / blocks) > SHARED and blocks < 16:
        blocks += 1
    return blocks


def runs_linked(keys: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all fingerprints within ``distance`` and with the same key; keys sorted.

    Rows of short runs are compared with the rows after them, all runs at once. In a long run links lead from a first
    fingerprint to all that it reaches, so that a run never gives more links than it has rows."""
    change = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    sizes = np.diff(np.concatenate([change, [len(prints)]]))
    size = np.repeat(sizes, sizes)
    left, right = [], []
    short = np.flatnonzero((size > 1) & (size <= 32))
    run = np.repeat(np.arange(len(sizes)), sizes)
    for step in range(1, int(size[short].max()) if len(short) else 0):
        a = short[short + step < len(prints)]
        a = a[run[a] == run[a + step]]
        a = a[np.bitwise_count(prints[a] ^ prints[a + step]) <= distance]
        left.append(prints[a])
        right.append(prints[a + step])
    for i in np.flatnonzero(sizes > 32):
        rest = prints[change[i] : change[i] + sizes[i]]
        while len(rest) > 1:
            root, rest, open_ = rest[0], rest[1:], [rest[0]]
            while open_ and len(rest):
                near = np.bitwise_count(rest ^ open_.pop()) <= distance
                if near.any():
                    found = rest[near]
                    left.append(np.full(len(found), root))
                    right.append(found)
                    open_.extend(found)
                    rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(prints: DataFrame, distance: int = 2, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints within ``distance`` bits.

    Pigeonhole: with ``blocks`` blocks of bits, ``distance`` differing bits leave ``blocks - distance`` whole, so each
    close pair shares one of the keys made of that many blocks. Rows meet by key, and Hamming distances are verified
    among the fingerprints of a key. Keys with more than ``bucket`` fingerprints are cut again by blocks of the bits
    that are left, which loses no pair, until they are small or 14 bits are left."""
    spark = prints.sparkSession
    prints = prints.select("fingerprint").distinct()
    blocks = blocks or block_count(prints.count(), distance)
    level = masks(list(range(64)), distance, blocks)
    keyed = lambda m: F.explode(F.array(*[F.struct(F.lit(x).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(x)).alias("key")) for x in m]))
    rows = prints.select(keyed(level).alias("k"), "fingerprint").select("k.mask", "k.key", "fingerprint")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros((0, 2), np.int64), np.zeros(0, np.uint64))
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("mask", "key")], axis=1)
            keys = np.concatenate([held[0], keys])
            values = np.concatenate([held[1], batch.column("fingerprint").to_numpy().view(np.uint64)])
            last = len(values) - int(np.argmax((keys[::-1] != keys[-1]).any(axis=1))) if (keys != keys[-1]).any() else 0
            if last:
                yield edges(*runs_linked(keys[:last], values[:last], distance))
            held = (keys[last:], values[last:])
        if len(held[1]):
            yield edges(*runs_linked(*held, distance))

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def near(cold: DataFrame) -> DataFrame:
        return cold.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(compare, "a long, b long")

    out = []
    while True:
        heavy = settle(rows.groupBy("mask", "key").count().filter(F.col("count") > bucket).select("mask", "key"))
        finer = []
        for m in {r["mask"] for r in heavy.select("mask").distinct().collect()}:  # as many as there are masks
            free = [b for b in range(64) if not m >> b & 1]
            if len(free) > 14:
                finer += [(m, m | x) for x in masks(free, distance, min(distance + 2, len(free)))]
        cut = spark.createDataFrame(finer or [(0, 0)], "mask long, finer long").filter(F.lit(bool(finer)))
        if not finer:
            out.append(near(rows))
            break
        heavy = heavy.join(cut.select("mask").distinct(), "mask", "left_semi")
        out.append(near(rows.join(heavy, ["mask", "key"], "left_anti")))
        hot = rows.join(heavy, ["mask", "key"], "left_semi").join(cut, "mask")
        rows = settle(hot.select(F.col("finer").alias("mask"), F.col("fingerprint").bitwiseAND(F.col("finer")).alias("key"), "fingerprint").distinct())
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def rooted(prints: DataFrame, least: Column, distance: int, blocks: int | None = None) -> DataFrame:
    """fingerprint, least, root of every fingerprint in ``prints``: ``least`` is an aggregate over its rows, ``root`` names
    its component."""
    classes = settle(prints.groupBy("fingerprint").agg(least.alias("least")))
    roots = settle(connected(links(classes, distance, blocks)))
    return classes.join(roots, classes["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over fingerprints that differ
    in at most ``distance`` bits.

    Every text takes part whole; a null or empty text has fingerprint zero and links like any other. Rows with equal
    fingerprints are one class, so copies meet as counts, not as pairs; every row of the input is returned, also
    repeated ones. Null doc_ids are no component's id unless it has no other (then null). Other columns are ignored.
    """
    prints = settle(fingerprints(docs, words).select("doc_id", "fingerprint"))
    named = rooted(prints, F.min("doc_id"), distance, blocks)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").select("fingerprint", "component_id")
    return prints.join(labels, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def first_row() -> Column:
    """The key of a group's row with the smallest (doc_id, hash), null doc_ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash"))


def rows_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key (``least``, see :func:`first_row`) is in ``chosen``, each once, with all columns."""
    named = lambda c: F.coalesce(c.cast("long"), F.lit(-(1 << 63))).alias("id")
    rows = docs.select(F.struct("*").alias("row"), named(F.col("doc_id")), row_hash())
    keys = chosen.select(named(F.col("least.doc_id")), F.col("least.hash").alias("hash"))
    return rows.join(keys, ["id", "hash"]).dropDuplicates(["id", "hash"]).select("row.*")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays, the one with the smallest (doc_id,
    hash of id and text), null doc_ids last. A doc_id may be null or shared by different texts: rows are told apart by
    id and text, so every component keeps a row. All columns are returned; only small keys and then the rows that stay,
    once, are shuffled."""
    prints = settle(fingerprints(docs, words))
    return rows_of(docs, rooted(prints, first_row(), distance).groupBy("root").agg(F.min("least").alias("least")))
