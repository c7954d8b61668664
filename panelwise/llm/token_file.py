"""Token-id files in Simple-8b words.

A file is a folder of Parquet rows, one row per frame: ``part`` and ``frame`` (their order is the order of the
documents), ``first`` (ids before the frame in its part), ``n_ids`` and ``payload``. A payload, little-endian:

    magic "S8W1", n_docs u32, n_blocks u32, n_words u32, n_ids u64
    doc_id i64 x n_docs, null flag u8 x n_docs, ids per document u64 x n_docs
    offset u32 x (n_blocks + 1): first word of each block of 128 ids
    word u64 x n_words

A word is a selector (top four bits) and up to 60 ids of equal width from the lowest bit on, so that no id crosses a
word. Selector 1 is the escape: the next word is one id of any 64-bit value. Blocks start in a new word, so they can be
decoded in any order; numpy decodes all words of a selector at once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import shared_folder, slices
from .tokens import encoder

#: Fixed values of the coding: ids in a word and bits of an id, by selector; selector 1 escapes.
COUNTS = [240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [0, 64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]
BLOCK = 128
FRAME_IDS = 1 << 20
HEADER = np.dtype([("magic", "S4"), ("docs", "<u4"), ("blocks", "<u4"), ("words", "<u4"), ("ids", "<u8")])
FRAMES = "part long, frame long, first long, n_ids long, payload binary"
TOKENS = "doc_id long, part long, first long, n_tokens long, ids_crc32 long"


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block of 128 ids and of the end); all blocks advance together."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    table = np.zeros((blocks, BLOCK + 240), np.uint64)
    full = np.zeros(blocks * BLOCK, np.uint64)
    full[:n] = ids
    table[:, :BLOCK] = full.reshape(blocks, BLOCK)
    sizes = np.full(blocks, BLOCK)
    if blocks:
        sizes[-1] = n - (blocks - 1) * BLOCK
    #: bits of an id, or more where a double cannot tell; run[b, i]: how many ids from i on fit each selector tried
    width = np.frexp(table[:, :BLOCK].astype(np.float64))[1].astype(np.uint8)
    top, place, runs, tried = int(width.max(initial=0)), np.arange(BLOCK, dtype=np.uint8), [], []
    for s in (s for s in range(16) if s != 1):
        bad = np.where(width > BITS[s], place, np.uint8(BLOCK))
        runs.append(np.minimum.accumulate(bad[:, ::-1], axis=1)[:, ::-1] - place)
        tried.append(s)
        if BITS[s] >= top:
            break  # it always fits; wider ones are never better
    run, want, tried = np.stack(runs, axis=-1), np.minimum(COUNTS, BLOCK).astype(np.uint8)[tried], np.array([*tried, 1])
    at, parts, owners = np.zeros(blocks, np.int64), [], []
    live = np.flatnonzero(at < sizes)
    while len(live):
        here, left = at[live], sizes[live] - at[live]
        fits = run[live, here] >= np.minimum(want, left[:, None].astype(np.uint8))
        chosen = tried[np.where(fits.any(axis=1), np.argmax(fits, axis=1), len(tried) - 1)]
        for s in np.unique(chosen):
            who = live[chosen == s]
            if s == 1:
                pair = np.stack([np.full(len(who), 1 << 60, np.uint64), table[who, at[who]]], axis=1)
                parts.append(pair.ravel())
                owners.append(np.repeat(who, 2))
            else:
                word = np.full(len(who), int(s) << 60, np.uint64)
                if BITS[s]:
                    count = COUNTS[s]
                    values = table[who[:, None], at[who][:, None] + np.arange(count)]
                    inside = np.arange(count) < (sizes[who] - at[who])[:, None]
                    shifts = (np.arange(count) * BITS[s]).astype(np.uint64)
                    word |= np.bitwise_or.reduce(np.where(inside, values, np.uint64(0)) << shifts, axis=1)
                parts.append(word)
                owners.append(who)
            at[who] = np.minimum(at[who] + COUNTS[s], sizes[who])
        live = live[at[live] < sizes[live]]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32)
    owner = np.concatenate(owners)
    words = np.concatenate(parts)[np.argsort(owner, kind="stable")]
    return words, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=blocks))]).astype(np.uint32)


def decode_words(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ids again; no step depends on the number of blocks."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 1):  # an escaped value may itself look like an escape
        if not raw[i]:
            raw[i + 1] = True
    counts = np.array(COUNTS)[selector]
    counts[(selector == 1) & ~raw] = 0
    counts[raw] = 1
    before = np.concatenate([[0], np.cumsum(counts)])
    block = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    start = before[:-1] - before[offsets[:-1].astype(np.int64)][block] + block * BLOCK
    out = np.zeros(len(offsets) * BLOCK + 240, np.uint64)
    out[start[raw]] = words[raw]
    for s in np.unique(selector[~raw]):
        if s in (0, 1):
            continue
        who = np.flatnonzero((selector == s) & ~raw)
        shifts = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        values = (words[who][:, None] >> shifts) & np.uint64((1 << BITS[s]) - 1)
        places = start[who][:, None] + np.arange(COUNTS[s])
        inside = places < np.minimum((block[who] + 1) * BLOCK, n)[:, None]
        out[places[inside]] = values[inside]
    return out[:n]


def frame(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = encode_words(ids)
    head = np.array([(b"S8W1", len(doc_ids), len(offsets) - 1, len(words), len(ids))], HEADER)
    return b"".join([
        head.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.asarray(lengths, "<u8").tobytes(),
        offsets.astype("<u4").tobytes(),
        words.astype("<u8").tobytes(),
    ])


def unframe(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, all ids) of a frame."""
    head = np.frombuffer(payload, HEADER, 1)[0]
    if head["magic"] != b"S8W1":
        raise ValueError("not a frame of token ids")
    at, out = HEADER.itemsize, []
    docs, blocks = int(head["docs"]), int(head["blocks"])
    for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", blocks + 1), ("<u8", int(head["words"]))):
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    names = [None if null else int(d) for d, null in zip(out[0], out[1], strict=True)]
    return names, out[2].astype(np.int64), decode_words(out[4], out[3], int(head["ids"]))


def write_token_file(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", blanks: bool = True, end_id: int | None = 0) -> None:
    """Write the ids of every text, in ascending doc_id order, to a token file at ``path``.

    ``tokenizer``: a public vocabulary or a file; ``blanks``: see :class:`.tokens.Encoder`; ``end_id`` follows every
    document. A null text is empty; a null doc_id comes first; rows with equal doc_id are ordered by their text's hash
    (equal rows in any order). Other columns are ignored. One range shuffle by doc_id, so a part is a range of ids;
    Spark's writer commits the frames of a part that has ended and repeats those of a lost one.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(tokenizer, blanks), TaskContext.get().partitionId()
        first = number = 0
        for batch in slices(batches, "text"):
            ids, ends = words.encode(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            if end_id is not None:
                ids = np.insert(ids, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
            starts = np.concatenate([[0], ends[:-1]])
            a = 0
            while a < len(names):
                b = max(a + 1, int(np.searchsorted(ends, starts[a] + FRAME_IDS, side="right")))
                part_ids = ids[starts[a] : ends[b - 1]]
                row = [[part], [number], [first], [len(part_ids)], [frame(names[a:b], (ends - starts)[a:b], part_ids)]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "frame", "first", "n_ids", "payload"])
                first, number, a = first + len(part_ids), number + 1, b

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(pack, FRAMES).write.option("compression", "zstd").parquet(path)


def read_token_file(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of a token file: doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if wanted, ids.

    Frames are decoded where they are read; only the number of ids of each part goes through one small window."""
    schema = TOKENS + (", ids array<long>" if with_ids else "")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, payload in zip(*(batch.column(c) for c in ("part", "first", "payload")), strict=True):
                names, lengths, ids = unframe(payload.as_py())
                ends = np.cumsum(lengths)
                small = ids.astype("<u4")
                sums = [zlib.crc32(small[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                columns = [
                    pa.array(names, pa.int64()),
                    pa.array(np.full(len(names), part.as_py())),
                    pa.array(first.as_py() + ends - lengths),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[e - n : e].astype(np.int64) for e, n in zip(ends, lengths, strict=True)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[f.strip().split(" ")[0] for f in schema.split(",")])

    frames = spark.read.schema(FRAMES).parquet(path)
    found = frames.select("part", "first", "payload").mapInArrow(unpack, schema)
    totals = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", before.alias("base"))
    rest = ["n_tokens", "ids_crc32"] + (["ids"] if with_ids else [])
    return found.join(bases, "part").select("doc_id", (F.col("base") + F.col("first")).alias("start"), *rest)


def token_file(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", blanks: bool = True, end_id: int | None = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write a token file (to the shared folder unless ``path`` is given) and read its documents back."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_file(docs, path, tokenizer, blanks, end_id)
    return read_token_file(spark, path, with_ids)
