"""Prefix trie of conversations, screened by a count-min sketch.

A prefix (the first d turns of a conversation) has a 128-bit digest: the exclusive or of hashes of its turns with their
places, so that it is a running aggregate. A count-min sketch of all digests says which prefixes surely belong to one
conversation: an estimate never falls below the count, so an estimate of one proves it. Those tails leave for the result
where they are; only prefixes that may be shared are shuffled and grouped exactly.

Subtree sums need no walk through the trie. Every node stands for its smallest member. A node's value goes to that
conversation, and a node's subtree holds the values of all its members, less what its own smallest member has above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import settle

#: Rows of a conversation that one window holds; longer conversations are cut.
RUN = 4096
#: log2 of the most cells of one of the sketch's two rows: their bits take 2 * 2**27 / 8 bytes, 32 MB, on driver and
#: workers. More digests than a quarter of that only screen less; the result is the same.
MOST_BITS = 27
#: Cells of a row of the sketch table, and entries that a task gathers before it hands them on.
CHUNK, HELD = 1 << 16, 1 << 20
WORDS = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "x1", "x2"]


def running(rows: DataFrame, conv: str, columns: list[str], aggregate: Callable[[str], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with ``columns`` replaced by their aggregates over all rows of the conversation up to the row's depth.

    A window holds ``RUN`` depths; totals of earlier windows are joined to those of conversations that have more."""
    cut = rows.withColumn("run", F.expr(f"depth div {RUN}"))
    inside = Window.partitionBy(conv, "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(conv).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    cut = settle(cut)
    long = cut.filter("run > 0").select(conv).distinct()
    totals = cut.join(long, conv, "left_semi").groupBy(conv, "run").agg(*[aggregate(c).alias(c) for c in columns])
    before = settle(totals.select(conv, "run", *[aggregate(c).over(earlier).alias(f"before_{c}") for c in columns]).filter("run > 0"))
    summed = cut.withColumns({c: aggregate(c).over(inside) for c in columns}).join(before, [conv, "run"], "left")
    return summed.withColumns({c: both(F.col(c), F.coalesce(f"before_{c}", F.lit(0).cast("long"))) for c in columns}).select(*rows.columns)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, place, turn_key, words)``: turns with their places from 1 in each conversation, and a digest of role and text.

    Turns are ordered by ``turn``, null first; equal ones by the digest. Rows without conv_id belong to no
    conversation and are left out; a null role or text is empty. The rows are sorted over all conversations, so that one
    with a third of all rows is numbered by many tasks: each numbers its own part, and the few conversations that reach
    over parts get what came before."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("turn_key"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    order = ["conv_id", "turn", "turn_key"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            place = np.arange(1, len(conv) + 1) - np.repeat(starts, np.diff(np.r_[starts, len(conv)]))
            if last == conv[0]:
                place[: starts[1] if len(starts) > 1 else len(conv)] += count
            last, count = conv[-1], int(place[-1])
            whole = pa.array(np.full(len(conv), part, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), whole, pa.array(place), batch.column("turn_key"), batch.column("words")], names=["conv_id", "part", "place", "turn_key", "words"])

    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    turns = settle(sorted_rows.mapInArrow(number, "conv_id long, part int, place long, turn_key binary, words long"))
    edges = turns.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    edges = edges.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv_id"))
    counts = turns.join(settle(edges), ["part", "conv_id"]).groupBy("part", "conv_id").agg(F.max("place").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = settle(counts.select("part", "conv_id", F.sum("n").over(earlier).alias("before")).filter("before IS NOT NULL"))
    place = (F.col("place") + F.coalesce("before", F.lit(0))).alias("place")
    return turns.join(before, ["part", "conv_id"], "left").select("conv_id", place, "turn_key", "words")


def with_shared_starts(turns: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``(conv_id, depth, turn_key, words, length)``: conversations c with their first h turns replaced by those of conversation
    c - c % ``every``, h = crc32(decimal c) % ``most``; depth 0 is a row of each, without a turn. ``length`` is
    the number of turns. A conversation that has fewer turns, or is not there, gives those it has."""
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    start = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = settle(convs.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), start.cast("long").alias("h")))
    given = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    kept = F.least("h", F.coalesce("there", F.lit(0)))
    convs = settle(convs.join(given, "base", "left").withColumn("kept", kept).withColumn("length", F.col("kept") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    first = convs.filter("kept > 0").join(heads, "base").filter("place <= kept").select("conv_id", F.col("place").alias("depth"), "turn_key", "words", "length")
    rest = turns.join(convs, "conv_id").filter("place > h")
    rest = rest.select("conv_id", (F.col("kept") + F.col("place") - F.col("h")).alias("depth"), "turn_key", "words", "length")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("turn_key"), F.lit(0).cast("long").alias("words"), "length")
    return roots.unionByName(first).unionByName(rest)


def digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, depth, x1, x2, p1, p2, words, ends)``: the digest of every prefix and of the one a turn shorter; depth 0 has zeros."""
    lanes = {"x1": F.xxhash64("depth", "turn_key"), "x2": F.xxhash64("turn_key", "depth")}
    rows = turns.select("conv_id", "depth", "words", (F.col("depth") == F.col("length")).alias("ends"),
                        *[F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(c).alias(x) for x, c in lanes.items()])
    rows = rows.withColumns({"p1": F.col("x1"), "p2": F.col("x2")})
    summed = running(rows, "conv_id", ["x1", "x2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    return summed.withColumns({"p1": F.col("p1").bitwiseXOR(F.col("x1")), "p2": F.col("p2").bitwiseXOR(F.col("x2"))})


class Sketch:
    """The cells of a two-row count-min sketch whose count is two or more."""

    def __init__(self, bits: int, cells: np.ndarray):
        self.bits, self.cells = bits, cells

    def cell(self, values: np.ndarray, row: int) -> np.ndarray:
        return (values.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64) + (row << self.bits)

    def may_be_shared(self, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
        out = np.ones(len(x1), bool)
        for row, x in enumerate((x1, x2)):
            at = self.cell(x, row)
            out &= (self.cells[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def sketch(prefixes: DataFrame, most_bits: int = MOST_BITS) -> Sketch:
    """The sketch of all digests of depth 1 and more: four cells or more a digest, up to ``2 ** most_bits`` a row.

    Tasks hand on which cells they met once and which more often, by chunks of cells; a chunk's counts meet in one task
    and leave it as 8 KB of bits. The driver holds the bits of both rows only, ``2 ** most_bits / 4`` bytes at most."""
    rows = prefixes.filter("depth > 0").select("x1", "x2")
    bits = int(np.clip(int(rows.count() * 4).bit_length(), CHUNK.bit_length() - 1, most_bits))
    empty = Sketch(bits, np.zeros(1, np.uint8))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            cell, n = np.unique(np.concatenate(held), return_counts=True)
            chunk = cell // CHUNK
            starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            low, often = (cell % CHUNK).astype("<u2"), n > 1
            pieces = [(low[a:b][~often[a:b]].tobytes(), low[a:b][often[a:b]].tobytes()) for a, b in zip(starts, [*starts[1:], len(cell)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(chunk[starts]), pa.array([p[0] for p in pieces], pa.binary()), pa.array([p[1] for p in pieces], pa.binary())], names=["chunk", "once", "often"])

        for batch in batches:
            held += [empty.cell(batch.column(c).to_numpy(), row) for row, c in enumerate(("x1", "x2"))]
            size += 2 * batch.num_rows
            if size >= HELD:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    def add(table: pa.Table) -> pa.Table:
        counts = np.zeros(CHUNK, np.uint8)
        for once, often in zip(table.column("once"), table.column("often"), strict=True):
            a, b = (np.frombuffer(x.as_buffer(), "<u2") for x in (once, often))
            counts[a] = np.minimum(counts[a] + 1, 2)  # a piece holds a cell once
            counts[b] = 2
        bits_ = np.packbits(counts > 1, bitorder="little").tobytes()
        return pa.table({"chunk": table.column("chunk")[:1], "bits": pa.array([bits_], pa.binary())})

    chunks = rows.mapInArrow(meet, "chunk long, once binary, often binary").groupBy("chunk").applyInArrow(add, "chunk long, bits binary")
    cells = np.zeros((2 << bits) // 8, np.uint8)
    for r in chunks.toLocalIterator():
        cells[r["chunk"] * CHUNK // 8 : (r["chunk"] + 1) * CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return Sketch(bits, cells)


def screened(prefixes: DataFrame, found: Sketch) -> DataFrame:
    """``prefixes`` with ``kind``: 2 may be shared (the root always), 1 one conversation's, below one that may be shared, 0 below such a one."""
    shared = prefixes.sparkSession.sparkContext.broadcast(found)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            depth, x1, x2, p1, p2 = (batch.column(c).to_numpy() for c in ("depth", "x1", "x2", "p1", "p2"))
            own = (depth == 0) | shared.value.may_be_shared(x1, x2)
            parent = (depth == 1) | shared.value.may_be_shared(p1, p2)
            kind = np.where(own, 2, np.where(parent, 1, 0)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kind)], names=[*batch.schema.names, "kind"])

    return prefixes.mapInArrow(mark, prefixes.withColumn("kind", F.lit(0)).schema)


def end_digests(ends: DataFrame) -> DataFrame:
    """``(depth, x1, x2, ends_sha256)``: SHA-256 of the comma-joined decimal conv_ids of each node's rows, ascending.

    The rows are sorted by node and conv_id over all tasks, which join their part of the ids in pieces of up to about 1 MB, so
    that a node where a third of all conversations end is cut; the hash itself then runs through the pieces of a node."""
    order = ["x1", "x2", "depth", "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{**dict(zip(NODE, node, strict=True)), "first": ids[0], "ids": ",".join(map(str, ids))}], schema=kinds)

        kinds = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        node, ids = None, []
        for batch in batches:
            made = []
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
                if key != node or len(ids) >= 50_000:
                    if ids:
                        made.append(out())
                    node, ids = key, []
                ids.append(conv)
            if made:
                yield pa.Table.from_batches(made).combine_chunks().to_batches()[0]
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        kinds = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])
        row = lambda: {**dict(zip(NODE, node, strict=True)), "ends_sha256": state.hexdigest()}
        for batch in batches:
            made = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        made.append(row())
                    node, state = key, hashlib.sha256(ids.encode())
            if made:
                yield pa.RecordBatch.from_pylist(made, schema=kinds)
        if node is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=kinds)

    pieces = ends.select(*NODE, "conv_id").repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = pieces.mapInArrow(join, "depth long, x1 long, x2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each distinct prefix of the conversations of :func:`with_shared_starts` (or any table of its columns).

    ``conv_id``: the smallest member, ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (over the subtree, (n_convs - 1) * words of the last turn) and ``ends_sha256`` (see :func:`end_digests`; of an empty
    string where no conversation ends). Equal conversations are members of the same nodes. No conversations: no rows, not even a
    root. Turns of any length and conversations of any number of turns are kept whole."""
    prefixes = settle(digests(turns))
    rows = settle(screened(prefixes, sketch(prefixes, most_bits)))
    maybe, top, tail = (rows.filter(F.col("kind") == k) for k in (2, 1, 0))
    nodes = settle(maybe.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2")))
    above = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")]
    children = nodes.filter("depth > 0").select(*above).unionByName(top.select(*above)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    value = ((F.col("n_convs") - 1) * F.col("words")).alias("value")
    nodes = nodes.join(children, NODE, "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), value)
    # values of nodes that the same conversation stands for, up to this one
    nodes = settle(running(nodes.withColumn("upto", F.col("value")), "conv_id", ["upto"], F.sum, lambda a, b: a + b))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    given = rows.filter("kind < 2 AND ends").select("conv_id", one.alias("leaf"), none.alias("value"))
    given = given.unionByName(nodes.select("conv_id", F.when(F.col("n_children") == 0, one).otherwise(none).alias("leaf"), "value").filter("leaf > 0 OR value > 0"))
    given = settle(given.groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("value").alias("value")))
    below = maybe.select("conv_id", *NODE).join(given, "conv_id").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("value").alias("under"))
    ends = end_digests(maybe.filter("ends"))
    reps = nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id"))
    root = nodes.filter("depth = 0").agg(F.min("conv_id")).first()[0]
    upper = {"depth": F.col("depth") - 1, "x1": F.col("p1"), "x2": F.col("p2")}

    def with_parent(table: DataFrame) -> DataFrame:
        """The root is the parent of so many nodes that it is not joined. A parent that is no row of ``nodes`` was proven to
        be one conversation's, so it and the node below it, marked by chance, are that conversation's own."""
        first = table.filter("depth = 1").withColumn("parent_conv_id", F.lit(root).cast("long"))
        own = [f"own_{c}" for c in NODE]
        deep = table.filter("depth > 1").withColumnsRenamed(dict(zip(NODE, own, strict=True)))
        joined = deep.withColumns({c: e if c != "depth" else F.col("own_depth") - 1 for c, e in upper.items()}).join(reps, NODE, "left")
        joined = joined.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
        joined = joined.drop(*NODE).withColumnsRenamed(dict(zip(own, NODE, strict=True)))
        top_node = table.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
        return top_node.unionByName(first).unionByName(joined)

    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    named = lambda c: F.col(c).cast("long").alias(c)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shared = nodes.join(below, NODE, "left").join(ends, NODE, "left").withColumn(
        "saved_tokens", F.coalesce("under", none) - (F.col("upto") - F.col("value"))
    )
    shared = with_parent(shared).select(*map(named, columns), F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    single = with_parent(top).select("conv_id", "depth", "parent_conv_id", "ends").unionByName(tail.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "ends"))
    single = single.select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(F.col("ends"), none).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        none.alias("saved_tokens"), F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return shared.unionByName(single)


#: The same by walking: digests of prefixes one turn after another, and every node's value given to all nodes above it.
TRIE_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS place,
    md5(length(role) || ':' || role || text) AS turn_key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, count(*) AS own, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295::BIGINT) % 4 AS h
  FROM turns GROUP BY conv_id
), sized AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS kept, least(c.h, coalesce(b.own, 0)) + greatest(c.own - c.h, 0) AS length
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
), rebuilt AS (
  SELECT s.conv_id, t.place AS depth, t.turn_key, t.words FROM sized s JOIN turns t ON t.conv_id = s.base AND t.place <= s.kept
  UNION ALL
  SELECT s.conv_id, s.kept + t.place - s.h, t.turn_key, t.words FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND t.place > s.h
), prefixes AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS digest, '' AS parent, 0::BIGINT AS words FROM sized
  UNION ALL
  SELECT p.conv_id, r.depth, md5(p.digest || r.turn_key), p.digest, r.words FROM prefixes p JOIN rebuilt r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1
), nodes AS (
  SELECT p.depth, p.digest, any_value(p.parent) AS parent, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.words) AS words,
    sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.depth = s.length), '')) AS ends_sha256
  FROM prefixes p JOIN sized s USING (conv_id) GROUP BY p.depth, p.digest
), children AS (
  SELECT depth - 1 AS depth, parent AS digest, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2
), sums AS (
  SELECT p.depth, p.digest, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((y.n_convs - 1) * y.words) AS saved_tokens
  FROM nodes y LEFT JOIN children c ON c.depth = y.depth AND c.digest = y.digest
  JOIN prefixes p ON p.conv_id = y.conv_id AND p.depth <= y.depth GROUP BY p.depth, p.digest
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.digest = n.digest
LEFT JOIN children c ON c.depth = n.depth AND c.digest = n.digest
LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.digest = n.parent
"""
