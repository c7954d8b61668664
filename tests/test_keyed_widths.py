"""Widths kept by a stream against the same recursion over a whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import adaptive as A
from panelwise.streaming.keyed_widths import keyed_widths


def run(spark, schema, folder):
    """One run over the files that are there; a second call goes on from the checkpoint."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out = keyed_widths(stream, ["model", "component"], 0.2, 0.1)
    query = out.writeStream.format("parquet").outputMode("append").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    return {(r["model"], r["component"], r["period"]): tuple(r[n] for n in ("alpha_t", "half_width", "miss")) for r in spark.read.parquet(str(folder / "out")).collect()}


def test_stream_equals_the_table_after_a_restart(spark, tmp_path):
    """A group with most rows, a null group, gaps, periods split over two batches, a restart amid a period, and late rows."""
    rng = np.random.default_rng(5)
    rows = [
        (m, None if m == "c" else "k", p, float(e), None if e == 7 else float(e + rng.normal(0, 1 + p % 2)))
        for m, size in (("a", 200), ("b", 12), ("c", 20)) for p in range(5) for e in range(size) if (m, p) != ("b", 2)
    ]
    df = spark.createDataFrame(rows, "model string, component string, period int, y double, yhat double")
    want = {(r["model"], r["component"], r["period"]): (r["alpha_t"], r["half_width"], r["miss"]) for r in A.adaptive_widths(df, ["model", "component"], 0.2, 0.1).collect()}
    halves = [(p, i) for p in range(5) for i in range(2)]

    def arrive(parts):
        for p, i in parts:
            df.where((F.col("period") == p) & (F.col("y") % 2 == i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    arrive(halves[:5])
    first = run(spark, df.schema, tmp_path)
    assert {k[2] for k in first} == {1}
    arrive(halves[5:])
    got = run(spark, df.schema, tmp_path)
    assert set(got) == {k for k in want if k[2] < 4} and len(got) == 8
    for k, v in got.items():
        assert v == pytest.approx(want[k])
    late = spark.createDataFrame([("a", "k", 1, 0.0, 1e6)] * 500 + [("a", "k", 5, 0.0, 0.0)], df.schema)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    more = run(spark, df.schema, tmp_path)
    assert all(more[k] == v for k, v in got.items()) and set(more) - set(got) == {("a", "k", 4)}
    assert more["a", "k", 4][1] == pytest.approx(1e6, rel=0.002) and more["a", "k", 4][2] == 0
