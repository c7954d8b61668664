import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from panelwise.llm.mixing import MIX_SQL, mix, source_rates

from . import fixtures


def poisson(u, rate):
    k, p, total = 0, math.exp(-rate), math.exp(-rate)
    while total <= u:
        k += 1
        p *= rate / k
        total += p
        if k > 10_000:
            raise AssertionError
    return k


def draw(seed, name, part=1):
    return int(hashlib.md5(f"{seed}|{name}|{part}".encode()).hexdigest()[:13], 16) / 2**52


def test_copies_and_order_against_plain_python(spark):
    docs = fixtures.documents(spark)
    for weights, epochs, unlisted in ((None, 1.0, 0.0), ({"a": 3.0, "hot": 1.0}, 2.5, 0.5), ({"a": 1.0}, 1.0, 0.0), ({}, 1.0, 0.0)):
        got = mix(docs, weights, epochs, unlisted, seed=9).select("row.doc_id", "row.source", "row.label", "rate", "copies", "copy", "position").collect()
        size = Counter()
        for r in docs.collect():
            size[r["source"]] += len((r["text"] or "").encode()) + 1
        weight = {s: 1.0 if weights is None else weights.get(s, unlisted) for s in size}
        total = sum(weight.values())
        want = Counter()
        for r in docs.collect():
            rate = epochs * sum(size.values()) * (weight[r["source"]] / total if total else 0.0) / size[r["source"]]
            name = "" if r["doc_id"] is None else r["doc_id"]
            for copy in range(1, poisson(draw(9, name), rate) + 1):
                want[r["doc_id"], r["source"], copy] += 1
        assert Counter((r["doc_id"], r["source"], r["copy"]) for r in got) == want
        assert sorted(r["position"] for r in got) == list(range(len(got)))
        name = lambda r: "" if r["doc_id"] is None else r["doc_id"]
        keys = [hashlib.md5(f"order 9|{name(r)}|{r['copy']}".encode()).hexdigest() for r in sorted(got, key=lambda r: r["position"])]
        assert keys == sorted(keys)


def test_large_rates_do_not_underflow(spark):
    docs = spark.createDataFrame([(1, "x", "small")] + [(i, "y" * 400, "large") for i in range(2, 12)], "doc_id long, text string, source string")
    rate = source_rates(docs, {"small": 1.0, "large": 1.0}).filter("source = 'small'").first()
    assert rate["rate"] > 1000 and rate["parts"] > 1
    n = mix(docs, {"small": 1.0, "large": 1.0}).filter(F.col("row.source") == "small").count()
    assert abs(n - rate["rate"]) < 6 * math.sqrt(rate["rate"])


def test_sources_reach_their_weights(spark):
    rows = [(i, "w" * (20 + i % 50), "hot" if i % 3 else f"s{i % 4}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mix(docs).groupBy("row.source").agg(F.sum(F.length("row.text") + 1).alias("size")).collect()
    mean = sum(r["size"] for r in got) / len(got)
    assert all(abs(r["size"] - mean) < 0.15 * mean for r in got)


def test_empty_table(spark):
    assert mix(fixtures.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mix(fixtures.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sql_with_high_rates(spark, tmp_path):
    """A source so small that its documents are repeated tens, or more than five hundred, times."""
    import pandas as pd

    from panelwise.llm.queries import QUERIES
    from tests.compare import differences, duck

    rows = [(i, "x" * (2_000 + i), "big") for i in range(20)] + [(100 + i, "y" * 250, "mid") for i in range(2)] + [(200, "zzzzzzz", "small"), (201, None, "small")]
    pd.DataFrame(rows, columns=["doc_id", "text", "source"]).to_parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_poisson_mixing"](spark, str(tmp_path))
    assert got.filter("source = 'small'").count() > 2_000 and got.filter("source = 'mid'").count() > 40
    assert differences(got, duck(str(tmp_path)), MIX_SQL) == []
