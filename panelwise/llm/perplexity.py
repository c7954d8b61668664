"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

The alphabet is open: every code point is a character of its own, so the tables of n-grams grow with the trusted text. They
are Spark tables, and what texts ask of them is joined by n-gram. Characters that trusted text never has share what the
first order leaves to them by 64 classes: a model of order 1 over the classes says how much of it each class gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from panelwise.session import settle_by

from .common import numbered, renamed, settle, slices, small_batches

CLASSES = 64
ORDER = 4
#: Letters beyond a-z with a class of their own.
LETTERS = "éèêáàâäöüßñíóúç"
#: Signs with a class of their own.
SIGNS = "\n.,!?|*#$%&:;"
#: Perplexities are ranked in cells of this width of their logarithm.
CELL = 0.001
#: Edge of a text among code points, and the bits that hold any of them; a context of three is one long.
EDGE, BITS = 0x110000, 21
#: Bytes of text in a block, which asks for each of its n-grams once, and in a slice of it that is coded at a time.
BLOCK, SLICE = 8 << 20, 1 << 20


def classes() -> np.ndarray:
    """Class of every code point: 0 edge of a text, 1 blank, 2-27 a-z, 28 A-Z, 29 other capitals of LETTERS, 30-44
    LETTERS, 45 digits, 46-58 SIGNS, 59 other ASCII, 60-63 the rest by code point."""
    out = (60 + np.arange(EDGE + 1) % 4).astype(np.uint32)
    out[:128] = 59
    out[ord(" ")] = 1
    for i in range(26):
        out[ord("a") + i], out[ord("A") + i] = 2 + i, 28
    for i, c in enumerate(LETTERS):
        out[ord(c)] = 30 + i
        if len(c.upper()) == 1:
            out[ord(c.upper())] = 29
    out[ord("0") : ord("9") + 1] = 45
    for i, c in enumerate(SIGNS):
        out[ord(c)] = 46 + i
    out[EDGE] = 0
    return out


TABLE = classes()


def sequence(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, each after order - 1 edges and before one; places of its characters and of the edge after
    them; end of each text in these places)."""
    edge = "\x00" * (order - 1)
    joined = "".join(edge + t + "\x00" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(lengths + order - 1) - lengths
    points[starts[:, None] - 1 - np.arange(order - 1)] = EDGE
    points[starts + lengths - 1] = EDGE
    ends = np.cumsum(lengths)
    return points, np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0), ends


def keys(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of classes that ends at each character, end of each text in them); a text ends with an edge and begins after
    edges."""
    points, places, ends = sequence(texts, order)
    codes = TABLE[points]
    gram = np.zeros(len(codes), np.uint32)
    for back in range(order - 1, -1, -1):
        gram[order - 1 :] = (gram[order - 1 :] << np.uint32(6)) | codes[order - 1 - back : len(codes) - back]
    return gram[places], ends


def unique(context: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts and characters of the different n-grams in order of appearance, number of each n-gram among these)."""
    before = pa.array(context).dictionary_encode()
    both = pa.array((np.asarray(before.indices).astype(np.int64) << BITS) | last).dictionary_encode()
    found = np.asarray(both.dictionary)
    return np.asarray(before.dictionary)[found >> BITS], found & ((1 << BITS) - 1), np.asarray(both.indices)


def grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(contexts and characters of the different n-grams of all texts; for each run of texts the number, among these, of the
    one that ends at each character, and each text's end in the run). A context holds the order - 1 code points before."""
    contexts, lasts, runs, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], 0
    while first < len(texts):
        stop, size = first + 1, len(texts[first])
        while stop < len(texts) and (size := size + len(texts[stop])) <= SLICE:
            stop += 1
        points, places, ends = sequence(texts[first:stop], order)
        codes = points.astype(np.int64)
        context = np.zeros(len(codes), np.int64)
        for back in range(order - 1, 0, -1):
            context[order - 1 :] = (context[order - 1 :] << BITS) | codes[order - 1 - back : len(codes) - back]
        context, last, number = unique(context[places], codes[places])
        contexts.append(context)
        lasts.append(last)
        runs.append((number, ends))
        first = stop
    context, last, among = unique(np.concatenate(contexts), np.concatenate(lasts))
    start = 0
    for i, (number, ends) in enumerate(runs):
        runs[i] = among[start : start + len(lasts[i + 1])][number], ends
        start += len(lasts[i + 1])
    return context, last, runs


def count_grams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, c) over all texts: each task adds up its texts, then counts meet by n-gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in slices(batches, "text", 1 << 20):
            found, _ = keys([t or "" for t in batch.column("text").to_pylist()], order)
            seen = pa.array(found).value_counts()
            both = np.concatenate([grams, np.asarray(seen.field("values"))])
            added = np.concatenate([counts, np.asarray(seen.field("counts"))])
            ranked = np.argsort(both, kind="stable")
            both, added = both[ranked], added[ranked]
            first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            grams, counts = both[first], np.add.reduceat(added, first)
        for i in range(0, len(grams), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[i : i + 100_000].astype(np.int64)), pa.array(counts[i : i + 100_000])], names=["gram", "c"])

    return texts.select("text").mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(f: dict[int, float]) -> list[float]:
    """Discounts of counts 1, 2 and more from the numbers of n-grams with counts 1 to 4; half the count where those do
    not give a positive one, so that every context leaves something to the order below."""
    y = f[1] / (f[1] + 2 * f[2]) if f.get(1) and f.get(2) else 0.0
    out = [k - (k + 1) * y * f.get(k + 1, 0.0) / f[k] if y and f.get(k) else 0.0 for k in (1, 2, 3)]
    return [d if 0 < d else k / 2 for k, d in zip((1, 2, 3), out, strict=True)]


def kneser_ney(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(n, gram, p, spare): interpolated modified Kneser-Ney probabilities of all n-grams of orders 1 to ``order``, and
    for each context of order n (as ``gram``, with ``p`` null) the mass it leaves to the order below.

    Lower orders count the different characters before an n-gram. Contexts' totals and discounts are joined to the
    counts by context, and the order below by suffix."""
    tables = {order: settle(counts)}
    for n in range(order - 1, 0, -1):
        size = CLASSES**n
        tables[n] = settle(tables[n + 1].groupBy((F.col("gram") % size).alias("gram")).agg(F.count("*").alias("c")))
    out, below = [], None
    for n in range(1, order + 1):
        table = tables[n]
        of = table.groupBy(F.least("c", F.lit(4)).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()
        f = {r["k"]: float(r["n"]) for r in of}
        d = discounts(f)
        cut = lambda c: F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])  # noqa: B023, E731
        context = F.floor(F.col("gram") / CLASSES).cast("long")
        table = table.withColumn("context", context).withColumn("off", cut(F.col("c")))
        sums = table.groupBy("context").agg(F.sum("c").alias("total"), F.sum("off").alias("lost"))
        sums = sums.withColumn("spare", F.col("lost") / F.col("total"))
        joined = table.join(sums, "context")
        if below is None:
            lower = F.lit(1.0 / CLASSES)
        else:
            suffix = below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            joined = joined.withColumn("suffix", F.col("gram") % CLASSES ** (n - 1)).join(suffix, "suffix")
            lower = F.col("lower")
        p = (F.col("c") - F.col("off")) / F.col("total") + F.col("spare") * lower
        below = settle(joined.select(F.lit(n).alias("n"), "gram", p.alias("p"), F.lit(None).cast("double").alias("spare")))
        out += [below, sums.select(F.lit(n).alias("n"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "spare")]
    return reduce(DataFrame.unionByName, out)


class Model:
    """Probabilities of the n-grams that occur and what their contexts leave, sorted by n-gram for each order."""

    def __init__(self, rows: dict[int, tuple[np.ndarray, ...]], order: int):
        self.rows, self.order = rows, order

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of the last class of each n-gram of the model's order after the ones before it."""
        p = np.full(len(grams), 1.0 / CLASSES)
        for n in range(1, self.order + 1):
            gram, value, context, spare = self.rows[n]
            own = grams % CLASSES**n
            p *= _value(context, spare, own // CLASSES, 1.0)
            p = _value(gram, value, own, p)
        return np.log(np.maximum(p, 1e-12))


def _value(keys_: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: np.ndarray | float) -> np.ndarray:
    if not len(keys_):
        return np.broadcast_to(default, len(wanted)).astype(float)
    at = np.minimum(np.searchsorted(keys_, wanted), len(keys_) - 1)
    return np.where(keys_[at] == wanted, values[at], default)


def train(trusted: DataFrame, order: int = ORDER) -> Model:
    """The model of the classes of all trusted texts."""
    return model_of(count_grams(trusted, order), order)


def model_of(counts: DataFrame, order: int) -> Model:
    """The model of n-grams of classes (gram, c); its rows, at most 2 * 64 ** n for an order n, are what the driver holds."""
    rows = kneser_ney(counts, order).toPandas()
    out = {}
    for n in range(1, order + 1):
        own = rows[rows["n"] == n].sort_values("gram")
        grams, contexts = own[own["p"].notna()], own[own["p"].isna()]
        out[n] = tuple(x.to_numpy() for x in (grams["gram"], grams["p"].astype("float32"), contexts["gram"], contexts["spare"].astype("float32")))
    return Model(out, order)


@dataclass(frozen=True)
class Grams:
    """Counts of the trusted text's n-grams (context, last, c) by order, discounts of counts 1, 2 and more, and what a character
    that it never has gets of the mass that the first order leaves, by class."""

    tables: dict[int, DataFrame]
    off: dict[int, list[float]]
    base: np.ndarray


def kept(n: int) -> int:
    """Bits of the context of an n-gram of order n."""
    return (1 << BITS * (n - 1)) - 1


def suffix(n: int) -> Column:
    return F.col("context").bitwiseAND(F.lit(kept(n))).alias("context")


def parts(columns: dict[str, np.ndarray], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of equally long columns, ``most`` at a time."""
    for i in range(0, len(next(iter(columns.values()))), most):
        yield pa.RecordBatch.from_pydict({k: pa.array(v[i : i + most]) for k, v in columns.items()})


def count(trusted: DataFrame, order: int = ORDER) -> Grams:
    """Counts of all trusted texts (``texts``: an array of them), sharded by n-gram. Lower orders count the different characters before an n-gram."""
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in batch.column("texts").to_pylist():
                context, last, runs = grams([t or "" for t in texts], order)
                c = sum((np.bincount(number, minlength=len(last)) for number, _ in runs), np.zeros(len(last), np.int64))
                yield from parts({"context": context, "last": last, "c": c})
            pa.default_memory_pool().release_unused()

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(TABLE[np.asarray(batch.column("last"))].astype(np.int64)), batch.column("c")], names=["gram", "c"])

    rows = trusted.select("texts").mapInArrow(found, "context long, last long, c long")
    with small_batches(rows.sparkSession, 2):  # rows are whole blocks, or slices of them
        tables = {order: settle(rows.groupBy("context", "last").agg(F.sum("c").alias("c")))}
    for n in range(order - 1, 0, -1):
        tables[n] = settle(tables[n + 1].groupBy(suffix(n), "last").agg(F.count("*").alias("c")))
    off = {}
    for n, table in tables.items():
        of = table.groupBy(F.least("c", F.lit(4)).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()
        off[n] = discounts({r["k"]: float(r["n"]) for r in of})
    by_class = tables[order].groupBy("last").agg(F.sum("c").alias("c")).mapInArrow(classed, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))
    shares = np.exp(model_of(by_class, 1).log_p(np.arange(CLASSES)))
    return Grams(tables, off, shares / np.bincount(TABLE, minlength=CLASSES))


def log_probabilities(asked: DataFrame, model: Grams) -> DataFrame:
    """(context, last, log_p) of different n-grams (context, last): each order's counts are joined by n-gram, its contexts'
    totals by context, and the order below by suffix."""
    order, base = max(model.tables), model.base

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = base[TABLE[np.asarray(batch.column("last"))]]
            yield pa.RecordBatch.from_arrays([batch.column("last"), pa.array(p)], names=["last", "lower"])

    wanted = {order: asked}
    for n in range(order - 1, 0, -1):
        wanted[n] = settle(wanted[n + 1].select(suffix(n), "last").distinct())
    below = wanted[1].select("last").mapInArrow(lowest, "last long, lower double")
    for n in range(1, order + 1):
        table, d = model.tables[n], model.off[n]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        sums = table.groupBy("context").agg(F.sum("c").alias("total"), F.sum(off).alias("lost"))
        if n == 1:
            rows = wanted[n].join(below, "last")
        else:
            rows = wanted[n].withColumn("suffix", suffix(n - 1)).join(below.withColumnRenamed("context", "suffix"), ["suffix", "last"]).drop("suffix")
        rows = rows.join(table, ["context", "last"], "left").join(sums, "context", "left")
        p = F.coalesce((F.col("c") - off) / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("lost") / F.col("total"), F.lit(1.0)) * F.col("lower")
        below = rows.select("context", "last", p.alias("lower"))
    return below.select("context", "last", F.log("lower").alias("log_p"))


def blocks(rows: DataFrame, text: str) -> DataFrame:
    """(block, doc_id, lang, rows): runs of rows of about BLOCK bytes of text, packed, with arrays of their doc_id and lang."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, text, BLOCK):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_batch(batch)
            one = lambda c: pa.array([batch.column(c).to_pylist()], pa.list_(batch.column(c).type))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([block]), one("doc_id"), one("lang"), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "doc_id", "lang", "rows"])
            block += 1

    return settle_by(rows.mapInArrow(pack, "block long, doc_id array<long>, lang array<string>, rows binary"), "block")


def unpacked(packed: bytes) -> pa.Table:
    with pa.ipc.open_stream(packed) as rows:
        return rows.read_all()


def whole_texts(rows: pa.Table, text: str) -> list[str]:
    return [t or "" for t in rows.column(text).to_pylist()]


def trusted_texts(packed: DataFrame, chosen: DataFrame, text: str) -> DataFrame:
    """(texts) of the rows of each block whose doc_id is ``chosen`` (doc_id) and not held out; about SLICE bytes a row."""
    ids = packed.select("block", F.posexplode("doc_id").alias("at", "doc_id"))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(5)) == 0
    at = settle(ids.filter(~held_out).join(chosen, "doc_id", "left_semi").groupBy("block").agg(F.collect_list("at").alias("at")))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed_, places in zip(batch.column("rows"), batch.column("at"), strict=True):
                found = unpacked(packed_.as_py()).column(text).combine_chunks().take(places.values)
                for some in slices(iter([pa.RecordBatch.from_arrays([found], names=["text"])]), "text", SLICE):
                    yield pa.RecordBatch.from_arrays([pa.array([some.column("text").to_pylist()], pa.list_(pa.string()))], names=["texts"])

    return packed.select("block", "rows").join(at, "block").select("rows", "at").mapInArrow(take, "texts array<string>")


def perplexities(packed: DataFrame, model: Grams, text: str) -> DataFrame:
    """(block, log_perplexity): mean negative log-probability of a character and the end of every text of each block.

    A block asks once for each of its n-grams; the probabilities come back to it by its number and the n-gram's place
    among those asked for."""
    order = max(model.tables)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed_ in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                context, last, _ = grams(whole_texts(unpacked(packed_.as_py()), text), order)
                yield from parts({"block": np.full(len(last), block), "at": np.arange(len(last), dtype=np.int32), "context": context, "last": last})
            pa.default_memory_pool().release_unused()

    def score(own: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for packed_ in own.column("rows"):
            _, last, runs = grams(whole_texts(unpacked(packed_.as_py()), text), order)
            log_p = np.full(len(last), np.nan)
            log_p[answers.column("at").to_numpy()] = answers.column("log_p").to_numpy()
            if np.isnan(log_p).any():
                raise RuntimeError("n-grams of a block got no probability")
            sums = [np.add.reduceat(log_p[number], np.concatenate([[0], ends[:-1]])) / -np.diff(ends, prepend=0) for number, ends in runs]
            out.append(np.concatenate(sums).tolist())
        pa.default_memory_pool().release_unused()
        return pa.table({"block": own.column("block"), "log_perplexity": pa.array(out, pa.list_(pa.float64()))})

    with small_batches(packed.sparkSession, 2):  # rows are whole blocks
        asks = settle(packed.select("block", "rows").mapInArrow(ask, "block long, at int, context long, last long"))
    asked = settle(asks.select("context", "last").distinct())
    answers = asks.join(log_probabilities(asked, model), ["context", "last"]).select("block", "at", "log_p")
    return packed.select("block", "rows").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "block long, log_perplexity array<double>")


def limits(scores: DataFrame, factor: float, least: int) -> dict[str | None, float]:
    """By language with ``least`` scores or more, and None for all: median + factor * (95 % quantile - median)."""
    cells = settle(scores.groupBy("lang", F.floor(F.col("log_perplexity") / CELL).alias("cell")).agg(F.count("*").alias("n")))
    either = cells.select(F.lit(True).alias("every"), F.lit(None).cast("string").alias("lang"), "cell", "n").union(
        cells.filter("lang IS NOT NULL").select(F.lit(False), "lang", "cell", "n")
    )
    either = either.groupBy("every", "lang", "cell").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("every", "lang").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("every", "lang")
    ranked = either.select("every", "lang", "cell", F.sum("n").over(up).alias("below"), F.sum("n").over(whole).alias("all"))
    at = lambda share: F.min(F.when(F.col("below") >= F.col("all") * share, F.col("cell")))
    found = ranked.groupBy("every", "lang").agg(at(0.5).alias("half"), at(0.95).alias("most"), F.max("all").alias("all"))
    rows = found.collect()  # one row a language
    return {None if r["every"] else r["lang"]: (r["half"] + factor * (r["most"] - r["half"]) + 1) * CELL for r in rows if r["every"] or r["all"] >= least}


def fit(rows: DataFrame, text: str, labels: DataFrame, factor: float = 3.0, least: int = 30, order: int = ORDER) -> tuple[DataFrame, DataFrame, dict]:
    """(blocks of all rows, log_perplexity of each block's rows, limits); see :func:`judge`."""
    good = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    packed = blocks(rows, text)
    model = count(trusted_texts(packed, good, text), order)
    scores = settle(perplexities(packed, model, text))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(5)) == 0
    return packed, scores, limits(listed(packed, scores).filter(held_out).join(good, "doc_id", "left_semi"), factor, least)


def listed(packed: DataFrame, scores: DataFrame) -> DataFrame:
    """doc_id, lang, log_perplexity of every row."""
    return packed.select("block", "doc_id", "lang").join(scores, "block").select(F.inline(F.arrays_zip("doc_id", "lang", "log_perplexity")))


def decided(scores: DataFrame, at: dict) -> DataFrame:
    """``scores`` with ``limit`` and ``accepted``."""
    named = [F.when(F.col("lang") == k, F.lit(v)) for k, v in sorted((k, v) for k, v in at.items() if k is not None)]
    limit = F.coalesce(*named, F.lit(at.get(None)).cast("double"))
    return scores.withColumn("limit", limit).withColumn("accepted", F.col("limit").isNull() | (F.col("log_perplexity") < F.col("limit")))


def judge(docs: DataFrame, labels: DataFrame, factor: float = 3.0, least: int = 30, order: int = ORDER) -> DataFrame:
    """doc_id, lang, log_perplexity, limit, accepted for every row of ``docs``.

    Trusted are all documents whose label says quality 1. The model is trained on four fifths of them (by a hash of
    doc_id); the others, unseen like the rest of the corpus, give the limits from quantiles of their language: median +
    ``factor`` * (95 % quantile - median). Documents above are rejected. A null language, or one with under ``least``
    such documents, takes the limit of all languages together. Without any trusted document nothing is rejected
    (limit null). A null or empty text is scored by the edge alone. Rows with equal doc_id are judged each for
    itself. Needs doc_id, text, lang; other columns are ignored, and labels may repeat a doc_id. ``order`` is 1 to 4.

    Texts are written once, as packed blocks in buckets, so that the joins with labels move numbers only and a block's
    probabilities come to where it lies. Counts meet by n-gram; a block and n-gram that it has are one row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    packed, scores, at = fit(rows, "text", labels, factor, least, order)
    return decided(listed(packed, scores), at)


def accepted(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`judge` accepts."""
    rows, names, (lang, text) = numbered(docs, "lang", "text")
    doc_id = names[[c.lower() for c in docs.columns].index("doc_id")]
    rows = rows.select(*dict.fromkeys((*names, text)), F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"))
    packed, scores, at = fit(rows, text, labels, **settings)
    schema = T.StructType([*rows.select(*names, "lang").schema.fields, T.StructField("log_perplexity", T.DoubleType())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed_, values in zip(batch.column("rows"), batch.column("log_perplexity"), strict=True):
                table = unpacked(packed_.as_py()).select([*names, "lang"]).append_column("log_perplexity", values.values)
                for part in table.combine_chunks().to_batches():
                    yield from slices(iter([part]), text, SLICE) if text in names else [part]

    found = packed.select("block", "rows").join(scores, "block").select("rows", "log_perplexity").mapInArrow(unpack, schema)
    return renamed(decided(found, at).filter("accepted"), docs)
