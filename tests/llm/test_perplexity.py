import math
from collections import Counter

import numpy as np

from panelwise.llm.perplexity import CLASSES, TABLE, accepted, judge, keys, train

from . import fixtures


def plain_model(texts, order):
    """Interpolated modified Kneser-Ney by its definition; returns a function of (context tuple, class)."""
    grams = Counter()
    for t in texts:
        c = [0] * (order - 1) + [int(TABLE[ord(x)]) for x in t] + [0]
        grams.update(tuple(c[i - order + 1 : i + 1]) for i in range(order - 1, len(c)))
    tables = {order: grams}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    discounts, sums, spare = {}, {}, {}
    for n, t in tables.items():
        f = Counter(min(v, 4) for v in t.values())
        y = f[1] / (f[1] + 2 * f[2]) if f[1] and f[2] else 0.0
        d = [k - (k + 1) * y * f[k + 1] / f[k] if y and f[k] else 0.0 for k in (1, 2, 3)]
        d = [0.0] + [v if v > 0 else k / 2 for k, v in zip((1, 2, 3), d, strict=True)]
        total, lost = Counter(), Counter()
        for g, v in t.items():
            total[g[:-1]] += v
            lost[g[:-1]] += d[min(v, 3)]
        discounts[n], sums[n], spare[n] = d, total, {c: lost[c] / total[c] for c in total}

    def p(context, x):
        n = len(context) + 1
        lower = p(context[1:], x) if n > 1 else 1.0 / CLASSES
        if context not in sums[n]:
            return lower
        v = tables[n].get((*context, x), 0)
        return (v - discounts[n][min(v, 3)] if v else 0.0) / sums[n][context] + spare[n][context] * lower

    return p


def test_model_against_its_definition(spark):
    texts = [fixtures.prose(i, 30) for i in range(12)] + ["", "Ünder É 12!", "###"]
    model = train(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3), 3)
    p = plain_model(texts + [""], 3)
    table = model.log_p(np.arange(CLASSES**3)).reshape(CLASSES, CLASSES, CLASSES)
    assert np.allclose(np.exp(table).sum(axis=2), 1, atol=1e-4)
    for a in (0, 1, 2, 10, 30, 46):
        for b in (0, 1, 7, 20, 63):
            for c in range(0, 64, 7):
                assert math.isclose(table[a, b, c], math.log(p((a, b), c)), rel_tol=1e-4, abs_tol=1e-4)


def test_keys_cover_every_character_and_the_end():
    found, ends = keys(["ab", "", "x"], 3)
    edge, a, b, x = 0, 2, 3, 25
    code = lambda *c: c[0] * 4096 + c[1] * 64 + c[2]
    assert found.tolist() == [code(edge, edge, a), code(edge, a, b), code(a, b, edge), code(edge, edge, edge), code(edge, edge, x), code(edge, x, edge)]
    assert ends.tolist() == [3, 4, 6]


def corpus(spark):
    good = [(i, fixtures.prose(i, 60), ["en", "de", None][i % 3], "a") for i in range(240)]
    bad = [(1000 + i, " ".join(w.upper() + "$$$" for w in fixtures.prose(i, 60).split()), "en", "a") for i in range(20)]
    rest = [(2000, None, "en", "a"), (2001, "", None, "a"), (None, fixtures.prose(3, 60), "en", "a"), good[5]]
    docs = spark.createDataFrame(good + bad + rest, "doc_id long, text string, lang string, limit string").repartition(4)
    labels = [(i, 1, 0) for i in range(0, 240, 2)] + [(1000 + i, 0, 0) for i in range(5)] + [(4, 1, 0), (None, 1, 0), (9999, 1, 0), (7, None, None)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_junk_goes_and_prose_stays(spark):
    docs, labels = corpus(spark)
    got = judge(docs, labels).collect()
    assert len(got) == docs.count()
    prose = [r["accepted"] for r in got if r["doc_id"] is not None and r["doc_id"] < 240]
    assert np.mean(prose) >= 0.97
    assert not any(r["accepted"] for r in got if r["doc_id"] is not None and 1000 <= r["doc_id"] < 1020)
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns
    key = lambda r: (r["doc_id"] or -1)
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in got if r["accepted"])


def test_nothing_trusted_and_empty(spark):
    docs, labels = corpus(spark)
    got = judge(docs, labels.limit(0)).collect()
    assert len(got) == docs.count() and all(r["accepted"] and r["limit"] is None for r in got)
    assert judge(fixtures.empty(spark), labels).count() == 0
    assert accepted(fixtures.documents(spark), labels.limit(0)).count() == fixtures.documents(spark).count()
