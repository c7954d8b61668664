"""Draws made inside tasks are those of the column expressions."""

from pyspark.sql import functions as F

from panelwise.functions.noise import poisson_counts, poisson_key, poisson_one
from panelwise.operators import evaluate, stacking


def test_counts_are_those_of_the_column(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b|c", None)], "k string, n int")
    want = df.select(*[poisson_one(5, F.lit(i), F.col("k"), F.col("n")).alias(f"r{i}") for i in range(1, 121)]).collect()
    names = [r[0] for r in df.select(poisson_key(F.col("k"), F.col("n"))).collect()]
    assert poisson_counts(5, 120, names).tolist() == [list(r) for r in want]


def test_a_key_is_drawn_once(spark, monkeypatch):
    """Rows of one key in many groups and tasks meet before they are drawn."""
    rows = [("m%d" % m, "K1", e, t, float((e + t) % 7), float((m + e * t) % 5)) for m in range(3) for e in range(4) for t in range(20)]
    df = spark.createDataFrame(rows, "model string, component string, entity int, period int, y double, yhat double").repartition(6)
    drawn = spark.sparkContext.accumulator(0)

    def counting(batches, *args, **kwargs):
        for piece, counts in with_counts(batches, *args, **kwargs):
            drawn.add(piece["_key"].nunique())
            yield piece, counts

    with_counts = evaluate.with_counts
    monkeypatch.setattr(evaluate, "with_counts", counting)
    monkeypatch.setattr(stacking, "with_counts", counting)
    evaluate.bootstrap(df, ["model"], ["entity"], 5, resamples=20).collect()
    assert drawn.value == 4
    drawn.value = 0
    assert len(stacking.weight_spread(df, ["m0", "m1", "m2"], 3, resamples=20).collect()) == 3
    assert drawn.value <= 4
