"""Alignment of two tokenizers over the same texts, by divide and conquer at shared cuts.

A byte offset where a token of either tokenizer ends is a shared cut. An interval of tokens is split at the shared cut
nearest to its middle, found by bisecting the other tokenizer's ends, and both halves go on; an interval without a cut
inside is a group. All intervals of a batch take a step at once.

A group's last tokens end together: that pair is its link. Counts of linked id pairs cover all texts. They meet blocks
of texts (each a few MB) rather than texts: a block asks once for each of its distinct pairs.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .common import settle, slices
from .sentence_pieces import pack_ids, pieces, ragged, unpack_ids
from .tokens import Encoder, vocabulary

#: Bytes of text that are encoded and aligned at once, and whose pairs form a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
PACKED = ["a_ids", "b_ids", "a_upto", "b_upto"]
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def byte_values() -> np.ndarray:
    """Byte of every character that byte-level vocabularies write for bytes: printable ones stand for themselves, the
    others are numbered from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    out = np.full(256 + len(rest), -1, np.int64)
    out[own] = own
    out[256:] = rest
    return out


class ByteLevel:
    """A byte-level vocabulary whose special tokens are plain text inside texts."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, blanks=True, cached=100_000)
        self.encoder.tokenizer.encode_special_tokens = True
        table = byte_values()
        names = {i: name for name, i in self.encoder.tokenizer.get_vocab().items()}
        spelled = []
        for i in range(max(names) + 1):
            points = [ord(c) for c in names.get(i, "")]
            known = all(p < len(table) and table[p] >= 0 for p in points)
            spelled.append(bytes(table[p] for p in points) if known else names[i].encode())
        self.width = np.array([len(s) for s in spelled], np.int64)
        self.first = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of a blank and the text, each."""
        blank, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
        ids, ends = self.encoder.encode(pc.binary_join_element_wise(blank, texts, none))
        return ids, np.asarray(ends, np.int64)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = self.width[ids]
        return self.bytes[ragged(self.first[ids], width)], width


_levels: dict[str, ByteLevel] = {}


def byte_level(name: str) -> ByteLevel:
    """One vocabulary for each worker process; ``name`` is a public vocabulary or the path of a file."""
    if name not in _levels:
        _levels[name] = ByteLevel(name if os.path.sep in name else vocabulary(name))
    return _levels[name]


def shared_cuts(a: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (of a, of b) after which both end, in order, for rising token ends ``a`` and ``b``.

    ``starts``: rows of (first a, stop a, first b, stop b), intervals whose last tokens end together. Every
    interval looks for the shared cut nearest to its middle token, in a window that grows fourfold until it holds one
    or covers the interval."""
    last_a, last_b = [starts[:, 1] - 1], [starts[:, 3] - 1]  # ends of the given intervals
    todo = starts[(starts[:, 1] - starts[:, 0] > 1) & (starts[:, 3] - starts[:, 2] > 1)]
    reach = np.ones(len(todo), np.int64)
    while len(todo):
        lo, hi = todo[:, 0], todo[:, 1] - 1  # the last token's end is the interval's own
        middle = (lo + hi) // 2
        left, right = np.maximum(lo, middle - reach + 1), np.minimum(hi, middle + reach)
        size = right - left
        owner = np.repeat(np.arange(len(todo)), size)
        token = ragged(left, size)
        at = np.searchsorted(b, a[token])
        fits = (at < todo[owner, 3] - 1) & (at >= todo[owner, 2])
        fits &= b[np.minimum(at, len(b) - 1)] == a[token]
        distance = np.where(fits, 2 * np.abs(token - middle[owner]) + (token > middle[owner]), np.iinfo(np.int64).max)
        first = np.cumsum(size) - size
        best = np.minimum.reduceat(distance, first)
        hit = np.flatnonzero(fits & (distance == best[owner]))
        found = owner[hit]
        last_a.append(token[hit])
        last_b.append(at[hit])
        cut_a, cut_b = token[hit] + 1, at[hit] + 1
        own = todo[found]
        halves = np.stack([own[:, 0], cut_a, own[:, 2], cut_b, cut_a, own[:, 1], cut_b, own[:, 3]], axis=1).reshape(-1, 4)
        missed = np.ones(len(todo), bool)
        missed[found] = False
        missed &= (left > lo) | (right < hi)  # something is left to look at
        halves = halves[(halves[:, 1] - halves[:, 0] > 1) & (halves[:, 3] - halves[:, 2] > 1)]
        reach = np.concatenate([np.ones(len(halves), np.int64), reach[missed] * 4])
        todo = np.concatenate([halves, todo[missed]])
        if missed.any():  # in order of the text, which bisecting likes best
            order = np.argsort(todo[:, 0], kind="stable")
            todo, reach = todo[order], reach[order]
    last_a, last_b = np.concatenate(last_a), np.concatenate(last_b)
    order = np.argsort(last_a)
    return last_a[order], last_b[order]


def _same_bytes(texts: pa.Array, spelled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text, whether its bytes (``sizes`` of them each) are a blank and the text."""
    want = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.int64) + 1
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts)]
    out = want == sizes
    starts = np.cumsum(sizes) - sizes
    rows = np.flatnonzero(out)
    n = want[rows] - 1
    differ = data[ragged(offsets[rows], n)] != spelled[ragged(starts[rows] + 1, n)]
    bad = np.searchsorted(np.cumsum(n), np.flatnonzero(differ), side="right")
    out[rows[bad]] = False
    out[rows] &= spelled[starts[rows]] == 0x20
    return out


def _aligned(texts: pa.Array, a_name: str, b_name: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(values, end of each text in them) of ids of A and B, and of the token counts of A and B up to each cut."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    a, b = byte_level(a_name), pieces(b_name)
    found = []
    good = np.asarray(pc.binary_length(texts).to_numpy(zero_copy_only=False), np.int64) > 0
    for one in (a, b):
        ids, ends = one.encode(texts)
        spelled, width = one.spell(ids)
        sizes = np.diff(np.concatenate([[0], np.cumsum(width)])[ends], prepend=0)
        good &= _same_bytes(texts, spelled, sizes)
        found.append((ids, ends, width))
    kept = []
    for ids, ends, width in found:
        lengths = np.diff(ends, prepend=0)
        stay = np.repeat(good, lengths)
        kept.append((ids[stay], np.cumsum(np.where(good, lengths, 0)), np.cumsum(width[stay])))
    (ids_a, ends_a, reach_a), (ids_b, ends_b, reach_b) = kept
    rows = np.flatnonzero(np.diff(ends_a, prepend=0) > 0)
    starts = np.column_stack([np.append(0, ends_a)[rows], ends_a[rows], np.append(0, ends_b)[rows], ends_b[rows]])
    cuts_a, cuts_b = shared_cuts(reach_a, reach_b, starts) if len(rows) else (np.zeros(0, np.int64),) * 2
    cut_ends = np.searchsorted(cuts_a, ends_a)
    text_of = np.repeat(np.arange(len(texts)), np.diff(cut_ends, prepend=0))
    upto_a = cuts_a + 1 - np.append(0, ends_a)[text_of]
    upto_b = cuts_b + 1 - np.append(0, ends_b)[text_of]
    return [(ids_a, ends_a), (ids_b, ends_b), (upto_a, cut_ends), (upto_b, cut_ends)]


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text: str = "text") -> DataFrame:
    """``docs`` with four packed columns in place of ``text`` (see ``sentence_pieces.pack_ids``): ``a_ids`` and ``b_ids``, and
    ``a_upto`` and ``b_upto``, the number of tokens of each up to the end of each group.

    ``a`` is a byte-level vocabulary and encodes a blank and the text, ``b`` a SentencePiece one, which adds the blank
    itself. A text that is null or empty, or that either tokenizer does not spell byte for byte, has no tokens: all four are
    empty. One row comes out for each row in; nulls in other columns stay, and other columns named like the four are
    replaced. Long texts are aligned whole. An empty table gives an empty table."""
    rows, others = _texts(docs, text)
    schema = T.StructType([*others, *[T.StructField(c, T.BinaryType()) for c in PACKED]])
    return rows.mapInArrow(_align_step(a, b, text), schema)


def _texts(docs: DataFrame, text: str) -> tuple[DataFrame, list[T.StructField]]:
    others = [c for c in docs.columns if c not in (text, *PACKED)]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("string").alias(text))
    return rows, [rows.schema[c] for c in others]


def _align_step(a: str, b: str, text: str) -> Step:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, BLOCK_BYTES):
            others = [c for c in batch.schema.names if c != text]
            packed = [pack_ids(values, ends) for values, ends in _aligned(batch.column(text), a, b)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *packed], names=[*others, *PACKED])

    return run


def _links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of A, id of B, end of each row in them): the last tokens of all groups."""
    sides = []
    for ids, upto in (("a_ids", "a_upto"), ("b_ids", "b_upto")):
        values, ends = unpack_ids(batch.column(ids))
        last, stops = unpack_ids(batch.column(upto))
        base = np.repeat(np.append(0, ends[:-1]), np.diff(stops, prepend=0))
        sides.append(values[base + last.astype(np.int64) - 1].astype(np.int64))
    return sides[0], sides[1], stops


def link_statistics(aligned: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row of :func:`align`, with ``n_links``, ``n_best`` (links whose pair is linked as often as any
    pair of its B id, over all rows) and ``count_sum`` (the sum over links of how often their pair is linked).

    Blocks of rows are written once. The distinct pairs of a block meet the counts of all pairs by a join, so a pair
    that every block holds costs a row a block; a block is put together again by its number, and its size is bounded by
    ``BLOCK_BYTES`` or one text. Rows without links have zeros. Null or repeated ids do no harm: rows keep their places
    in blocks."""
    kept = [aligned.schema[c] for c in columns]
    return _meet(aligned.select(*[F.col(f"`{c}`") for c in dict.fromkeys((*columns, *PACKED))]).mapInArrow(_block_step(columns), _block_schema(kept)), kept)


def align_and_link(
    docs: DataFrame, measures: dict[str, tuple[T.DataType, Callable[[pa.RecordBatch], pa.Array]]],
    a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", text: str = "text",
) -> DataFrame:
    """:func:`align` and :func:`link_statistics` in one pass over the texts: all columns of ``docs`` but ``text``, the ``measures`` (a type
    and a function of the rows that ``align`` gives) and the link statistics; the aligned rows never leave the worker."""
    rows, others = _texts(docs.drop(*measures), text)
    kept = [*others, *[T.StructField(name, kind) for name, (kind, _) in measures.items()]]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [get(batch) for _, get in measures.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, *measures])

    read, put = _align_step(a, b, text), _block_step([f.name for f in kept])
    return _meet(rows.mapInArrow(lambda batches: put(measure(read(batches))), _block_schema(kept)), kept)


def _block_schema(kept: list[T.StructField]) -> T.StructType:
    parts = [("block", T.LongType()), ("a", T.ArrayType(T.IntegerType())), ("b", T.ArrayType(T.IntegerType())), ("n", T.ArrayType(T.LongType()))]
    parts += [("pair", T.BinaryType()), ("times", T.BinaryType()), ("stops", T.BinaryType())]
    rows = [T.StructField(f"c{i}", T.ArrayType(f.dataType)) for i, f in enumerate(kept)]
    return T.StructType([*[T.StructField(name, kind) for name, kind in parts], *rows])


def _block_step(columns: list[str]) -> Step:
    """A row for each batch of aligned rows: its distinct pairs with their counts, and which of them each row holds how often."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "a_ids", 4 * BLOCK_BYTES):
            a, b, ends = _links(batch)
            key, index = np.unique(a << 32 | b, return_inverse=True)
            row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            both, times = np.unique(row * max(len(key), 1) + index, return_counts=True)
            row, pair = np.divmod(both, max(len(key), 1))
            stops = np.searchsorted(row, np.arange(len(ends)), side="right")
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            whole = lambda x: pack_ids(x, np.array([len(x)]))
            out = [pa.array([number]), one(key >> 32, pa.int32()), one(key & 0xFFFFFFFF, pa.int32()), one(np.bincount(index, minlength=len(key)), pa.int64())]
            out += [whole(pair), whole(times), whole(stops)]
            out += [pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), batch.column(c)) for c in columns]
            yield pa.RecordBatch.from_arrays(out, names=["block", "a", "b", "n", "pair", "times", "stops", *[f"c{i}" for i in range(len(columns))]])
            number += 1

    return block


def _meet(blocks: DataFrame, kept: list[T.StructField]) -> DataFrame:
    """The rows of blocks with what all blocks say about their pairs."""
    blocks = settle(blocks)
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "of")).select("block", "place", "of.*")
    counts = settle(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    known = counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    asked = pairs.join(known, ["a", "b"]).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "count", "best"))).alias("found"))
    asked = asked.select("block", F.col("found.count").alias("count"), F.col("found.best").alias("best"))
    out_schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")]])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                pair, times, stops = (unpack_ids(one.column(c))[0].astype(np.int64) for c in ("pair", "times", "stops"))
                count, best = (np.asarray(one.column(c).flatten(), np.int64) for c in ("count", "best"))
                rows = len(stops)
                row = np.repeat(np.arange(rows), np.diff(stops, prepend=0))
                made = []
                for value in (times, times * best[pair], times * count[pair]):
                    total = np.zeros(rows, np.int64)
                    np.add.at(total, row, value)
                    made.append(pa.array(total))
                yield pa.RecordBatch.from_arrays([*[one.column(f"c{k}").flatten() for k in range(len(kept))], *made], names=out_schema.names)

    columns = ["pair", "times", "stops", *[f"c{i}" for i in range(len(kept))]]
    return blocks.select("block", *columns).join(asked, "block", "left").select("count", "best", *columns).mapInArrow(sums, out_schema)


_DIGITS: dict[str, np.ndarray] = {}


def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to 99,999, padded with zeros on the right, and how many there are."""
    if not _DIGITS:
        names = [str(i).encode() for i in range(100_000)]
        _DIGITS["text"] = np.frombuffer(b"".join(n.ljust(6, b"\0") for n in names), np.uint8).reshape(-1, 6)
        _DIGITS["width"] = np.array([len(n) for n in names])
    return _DIGITS["text"], _DIGITS["width"]


def written_groups(batch: pa.RecordBatch) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for every row of :func:`align`: decimal ids, groups in order; ids below 100,000."""
    (a, a_ends), (b, b_ends) = (unpack_ids(batch.column(c)) for c in ("a_ids", "b_ids"))
    (a_upto, cuts), (b_upto, _) = (unpack_ids(batch.column(c)) for c in ("a_upto", "b_upto"))
    row = np.repeat(np.arange(len(cuts)), np.diff(cuts, prepend=0))
    a_stop = a_upto.astype(np.int64) + np.append(0, a_ends[:-1])[row]  # token numbers of the batch
    b_stop = b_upto.astype(np.int64) + np.append(0, b_ends[:-1])[row]
    group_a = np.repeat(np.arange(len(a_stop)), np.diff(a_stop, prepend=0))
    group_b = np.repeat(np.arange(len(b_stop)), np.diff(b_stop, prepend=0))
    at_a = np.arange(len(a)) + np.append(0, b_stop)[group_a]
    at_b = np.arange(len(b)) + a_stop[group_b]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[at_a], ids[at_b] = a, b
    sign = np.full(len(ids), ord(","), np.uint8)
    sign[at_a[a_stop - 1]] = ord("|")
    sign[at_b[b_stop - 1]] = ord(";")
    text, width = _digits()
    cells, size = text[ids], width[ids]
    cells[np.arange(len(ids)), size] = sign
    flat = cells[np.arange(6) <= size[:, None]].tobytes()
    upto = np.append(0, np.cumsum(size + 1))
    stops = upto[a_ends + b_ends]
    return [flat[s : e - 1] if e > s else b"" for s, e in zip(np.append(0, stops[:-1]).tolist(), stops.tolist(), strict=True)]
