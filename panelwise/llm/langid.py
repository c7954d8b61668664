"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered, renamed, settle, slices

#: Hash buckets of the n-grams, as a power of two.
BITS = 14
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Settings:
    """``sample``: documents that the weights are fitted on, about so many for each language (all if there are fewer);
    a fifth of them only calibrates. ``alpha``, ``beta``: step sizes of follow-the-regularised-leader; ``l1``, ``l2``:
    elastic net; ``rounds`` of ``parts`` parallel passes whose states are averaged."""

    sample: int = 2000
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 0.1
    rounds: int = 3
    parts: int = 4


def buckets(text: str) -> np.ndarray:
    """Hash bucket of every 1-, 2- and 3-gram of the lower-cased text, white space around it included."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = points * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (points[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
    three = (two[:-1] ^ (points[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    mixed = np.concatenate([one * np.uint32(0x2545F491), two, three])
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32((1 << BITS) - 1)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): (1 + ln count) * idf, of length 1."""
    counts = np.bincount(buckets(text), minlength=1 << BITS)
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    norm = np.sqrt(values @ values)
    return at, values / norm if norm else values


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each bucket, documents) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((1 << BITS) + 1, np.int64), 0
        for batch in slices(batches, "text", 2 << 20):
            for text in batch.column("text").to_pylist():
                total[:-1] += np.bincount(buckets(text), minlength=1 << BITS) > 0
                n += 1
        total[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((1 << BITS) + 1, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out[:-1], int(out[-1])


def weights(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Weights of follow-the-regularised-leader; exactly zero where |z| <= l1."""
    return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0
        at, values = features(text, self.idf)
        p = softmax(values @ self.weights[at] / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def draw(column: Column) -> Column:
    """A number in [0, 1) from a row's doc_id."""
    return F.pmod(F.xxhash64(column, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def train(rows: DataFrame, s: Settings = Settings()) -> Model:
    """The model of rows (doc_id, text, lang) without nulls; IDF from all of them, weights from the sample."""
    spark = rows.sparkSession
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), np.zeros(1 << BITS), np.zeros((1 << BITS, 0)), 1.0)
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    ticket = draw(F.col("doc_id"))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, s.sample / c))) for k, c in sizes.items()])
    tuned = F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(5)) == 0
    drawn = rows.filter(ticket < share).select("text", "lang", tuned.alias("tunes"), F.xxhash64("doc_id", F.lit(13)).alias("turn"))
    number = {k: i for i, k in enumerate(langs)}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = [features(t, idf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([number[k] for k in batch.column("lang").to_pylist()], pa.int32()), batch.column("tunes"), batch.column("turn"),
                pa.array([a.astype("<i4").tobytes() for a, _ in found]), pa.array([v.astype("<f8").tobytes() for _, v in found]),
            ], names=["y", "tunes", "turn", "at", "value"])

    table = settle(drawn.mapInArrow(extract, "y int, tunes boolean, turn long, at binary, value binary"))
    size = (1 << BITS, len(langs))
    z, squares = np.zeros(size), np.zeros(size)
    shards = table.filter("NOT tunes").repartition(s.parts, F.pmod("turn", F.lit(s.parts))).sortWithinPartitions("turn")

    def passes(state):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z, n = (x.copy() for x in state.value)
            seen = 0
            for batch in batches:
                for y, at, value in zip(*(batch.column(c) for c in ("y", "at", "value")), strict=True):
                    at, x = np.frombuffer(at.as_py(), "<i4"), np.frombuffer(value.as_py(), "<f8")
                    w = weights(z[at], n[at], s)
                    p = softmax(x @ w)
                    p[y.as_py()] -= 1
                    g = np.outer(x, p)
                    step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
                    z[at] += g - step * w
                    n[at] += g * g
                    seen += 1
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([z.tobytes()]), pa.array([n.tobytes()])], names=["z", "n"])

        return run

    for _ in range(s.rounds):
        state = spark.sparkContext.broadcast((z, squares))
        found = shards.mapInArrow(passes(state), "z binary, n binary").collect()  # ``parts`` states of fixed size
        if found:
            z, squares = (np.mean([np.frombuffer(r[c]).reshape(size) for r in found], axis=0) for c in ("z", "n"))
    w = weights(z, squares, s)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(v.as_py(), "<f8") @ w[np.frombuffer(a.as_py(), "<i4")] for a, v in zip(batch.column("at"), batch.column("value"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(rows, pa.list_(pa.float64()))], names=["y", "logits"])

    held = table.filter("tunes").mapInArrow(logits, "y int, logits array<double>").toPandas()  # of the sample
    temperature = 1.0
    if len(held):
        x, y = np.array(held["logits"].tolist()), held["y"].to_numpy()
        tries = np.geomspace(0.05, 5, 120)
        losses = [-np.log(np.maximum(softmax(x / t)[np.arange(len(y)), y], 1e-300)).mean() for t in tries]
        temperature = float(tries[int(np.argmin(losses))])
    return Model(langs, idf, w, temperature)


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang of the rows that have all three."""
    known = F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()
    return docs.filter(known).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def predictions(rows: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """``columns``, lang_pred and score of every row, from ``text`` alone."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = rows.select(*dict.fromkeys((*columns, text)))
    schema = rows.select(*columns).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            found = [shared.value.predict(t) for t in batch.column(text).to_pylist()]
            langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], langs, scores], names=[*columns, "lang_pred", "score"])

    return kept.mapInArrow(predict, schema)


def identify(docs: DataFrame, learn: Column | None = None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``.

    Learns from the rows with non-null doc_id, text and lang for which ``learn`` holds (all by default); predicts from
    the text alone. ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null or has no letter, or
    if there was nothing to learn from; ``score`` is the calibrated probability. Whole texts are read where they lie; only
    sums over hash buckets and the sample's features are shuffled. Repeated rows are predicted each for itself; other
    columns are ignored.
    """
    model = train(labelled(docs if learn is None else docs.filter(learn)), settings)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predictions(rows, model, ["doc_id"])


def recognised(docs: DataFrame, least: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with a score of ``least`` or more. If
    there was nothing to learn from, all rows are returned."""
    model = train(labelled(docs), settings)
    if not model.langs:
        return docs
    rows, names, (text,) = numbered(docs, "text")
    return renamed(predictions(rows, model, names, text).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs)
