"""Packing documents into sequences: minimum bin slack over the available lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import settle, slices
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths (with repeats, at most ``counts`` of each) whose sum is as near to ``room`` as it can be.

    Bit s of a set says that s tokens can be filled. Lengths are added from the longest on; the search ends as soon as
    the room can be filled to the last token, and goes back through the sets to find the lengths used."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for n in lengths:
        if n > room:
            continue
        times, step = min(counts[n], room // n), 1
        while times:  # 1, 2, 4, .. copies at once
            take = min(step, times)
            more = (reach << (take * n)) & mask
            if more & ~reach:
                steps.append((reach, take, n))
                reach |= more
            times, step = times - take, step * 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, []
    for before, take, n in reversed(steps):
        if not before >> total & 1:
            used += [n] * take
            total -= take * n
    return used


def patterns(counts: dict[int, int], size: int) -> list[tuple[int, Counter]]:
    """(how many bins, lengths in each) for all items. A bin takes the longest length left and the fullest combination
    for the rest; it is repeated while the counts allow it, so every step uses up a length."""
    left, out = {n: c for n, c in counts.items() if c}, []
    lengths = sorted(left, reverse=True)
    while left:
        longest = next(n for n in lengths if n in left)
        left[longest] -= 1
        bin_ = Counter([longest]) + Counter(fullest(left, [n for n in lengths if left.get(n)], size - longest))
        left[longest] += 1
        times = min(left[n] // m for n, m in bin_.items())
        out.append((times, bin_))
        for n, m in bin_.items():
            left[n] -= times * m
            if not left[n]:
                del left[n]
        lengths = [n for n in lengths if n in left]
    return out


def places(found: list[tuple[int, Counter]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first item of each pattern that holds it, copies in a bin, first bin, offset in the bin."""
    rows: dict[int, list] = {}
    taken: Counter = Counter()
    bins = 0
    for times, bin_ in found:
        offset = 0
        for n, m in sorted(bin_.items(), reverse=True):
            rows.setdefault(n, []).append((taken[n], m, bins, offset))
            taken[n] += times * m
            offset += n * m
        bins += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}


def token_pieces(docs: DataFrame, size: int, tokenizer: str, blanks: bool, end_id: int | None) -> DataFrame:
    """Pieces of at most ``size`` tokens, each numbered among the pieces of its length in its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = encoder(tokenizer, blanks), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in slices(batches, "text", 2 << 20):
            ids, ends = words.encode(batch.column("text"))
            if end_id is not None:
                ids = np.insert(ids, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
            starts = np.concatenate([[0], ends[:-1]])
            pieces = -(-(ends - starts) // size)
            doc = np.repeat(np.arange(len(ends)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(size, (ends - starts)[doc] - start)
            order = np.argsort(length, kind="stable")
            firsts = np.searchsorted(length[order], length[order])
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - firsts + seen[length[order]]
            seen += np.bincount(length, minlength=size + 1)
            small = ids.astype("<u4")
            begin = starts[doc] + start
            sums = [zlib.crc32(small[b : b + n]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), piece.astype(np.int32), start, length, np.array(sums, np.int64), np.full(len(doc), part), nth]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[f.strip().split(" ")[0] for f in PIECES.split(",")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack(docs: DataFrame, size: int = 4096, tokenizer: str = "word_bpe_49k.json", blanks: bool = False, end_id: int | None = 1) -> DataFrame:
    """Place of every document, or of its pieces of at most ``size`` tokens, in sequences of at most ``size`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. Only documents longer
    than ``size`` are cut. A null text is empty (its end id is packed; without one it has no piece); rows with equal or null doc_id are packed
    each for itself; other columns are ignored. Sequences hold no gaps.

    Documents are read once, where they lie. What meets in one place is the number of pieces of each length, at most
    ``size`` numbers whatever the input: items of one length can be exchanged, so the search for the fullest
    combination runs over lengths and gives bins with a count. A piece finds its place from its number among the
    pieces of its length: the number in its partition plus those of the partitions before.
    """
    spark = docs.sparkSession
    pieces = settle(token_pieces(docs, size, tokenizer, blanks, end_id))
    cells = settle(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(patterns(counts, size)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, item = batch.column("length").to_numpy(), batch.column("item").to_numpy()
            sequence, offset = np.empty(len(item), np.int64), np.empty(len(item), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, copies, base, at = table.value[int(n)]
                k = np.searchsorted(first, item[rows], side="right") - 1
                nth = item[rows] - first[k]
                sequence[rows] = base[k] + nth // copies[k]
                offset[rows] = at[k] + nth % copies[k] * n
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = pieces.join(bases, ["part", "length"]).select(*kept, (F.col("base") + F.col("nth")).alias("item"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
