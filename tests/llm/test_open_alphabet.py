"""Every code point is a character of its own, and texts get their probabilities by joins with the counts."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelwise.llm import perplexity
from panelwise.llm.perplexity import EDGE, TABLE, accepted, count, grams, judge, log_probabilities, train

from . import fixtures

ALPHABETS = {"ru": "\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u043a\u043b\u043c\u043d\u043e\u043f\u0440\u0441\u0442\u0443", "zh": "".join(chr(0x4E00 + 7 * i) for i in range(60))}


def words(lang, n=40):
    r = random.Random(lang)
    return ["".join(r.choice(ALPHABETS[lang]) for _ in range(r.randint(2, 6))) for _ in range(n)]


def prose(lang, seed, n=60):
    r, known = random.Random(seed), words(lang)
    return " ".join(r.choice(known) for _ in range(n))


def moved(text):
    """Every letter four code points on: the same code points modulo 4."""
    return "".join(c if c == " " else chr(ord(c) + 4) for c in text)


def coded(text, order):
    return [EDGE] * (order - 1) + [ord(c) for c in text] + [EDGE]


def plain_model(texts, order, base):
    """Interpolated modified Kneser-Ney of code points by its definition; returns a function of (context tuple, code point)."""
    tables = {order: Counter(tuple(c[i - order + 1 : i + 1]) for t in texts for c in [coded(t, order)] for i in range(order - 1, len(c)))}
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    off, total, lost = {}, {}, {}
    for n, t in tables.items():
        off[n] = [0.0, *perplexity.discounts({k: float(v) for k, v in Counter(min(v, 4) for v in t.values()).items()})]
        total[n], lost[n] = Counter(), Counter()
        for g, v in t.items():
            total[n][g[:-1]] += v
            lost[n][g[:-1]] += off[n][min(v, 3)]

    def p(context, x):
        n = len(context) + 1
        lower = p(context[1:], x) if n > 1 else base[TABLE[x]]
        if context not in total[n]:
            return lower
        v = tables[n].get((*context, x), 0)
        return (v - off[n][min(v, 3)] + lost[n][context] * lower) / total[n][context]

    return p


def test_every_character_and_end_in_any_slices(monkeypatch):
    texts = [prose("ru", 1, 5), "", "a\x00\U0001f600", prose("zh", 2, 9), "ab"]
    for size in (1, 20, 1 << 20):
        monkeypatch.setattr(perplexity, "SLICE", size)
        context, last, runs = grams(texts, 4)
        number = np.concatenate([number for number, _ in runs])
        ends = np.cumsum(np.concatenate([np.diff(ends, prepend=0) for _, ends in runs]))
        assert len(set(zip(context.tolist(), last.tolist(), strict=True))) == len(last)
        assert ends.tolist() == np.cumsum([len(t) + 1 for t in texts]).tolist()
        want = [tuple(c[i - 3 : i + 1]) for t in texts for c in [coded(t, 4)] for i in range(3, len(c))]
        part = lambda k: (context[number] >> 21 * k) & ((1 << 21) - 1)  # noqa: B023, E731
        assert list(zip(part(2).tolist(), part(1).tolist(), part(0).tolist(), last[number].tolist(), strict=True)) == want


def test_joined_probabilities_against_the_definition(spark):
    texts = [prose("ru", i, 12) for i in range(8)] + [prose("zh", i, 12) for i in range(8)] + [fixtures.prose(i, 20) for i in range(6)] + ["", "Z\U0001f600"]
    trusted = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string").repartition(3)
    others = texts[:1] + [moved(texts[0]), moved(texts[9]), "Zebra \u0001 \u00d1\uffff", ""]
    for order in (1, 4):
        model = count(trusted.select(F.array("text").alias("texts")), order)
        shares = np.exp(train(trusted, 1).log_p(np.arange(64)))
        assert math.isclose(float((model.base * np.bincount(TABLE, minlength=64)).sum()), 1, rel_tol=1e-5)
        p = plain_model([*texts, ""], order, shares / np.bincount(TABLE, minlength=64))
        context, last, _ = grams(others, order)
        asked = spark.createDataFrame([*zip(context.tolist(), last.tolist(), strict=True)], "context long, last long").repartition(3)
        got = log_probabilities(asked, model).collect()
        assert len(got) == len(last)
        for r in got:
            before = tuple((r["context"] >> 21 * k) & ((1 << 21) - 1) for k in range(order - 2, -1, -1))
            assert math.isclose(r["log_p"], math.log(p(before, r["last"])), rel_tol=1e-9)


def test_prose_of_any_script_is_told_from_other_characters_of_its_block(spark):
    good = [(k * 1000 + i, prose(lang, i), lang) for k, lang in enumerate(ALPHABETS) for i in range(240)]
    bad = [(9000 + i, moved(prose(lang, 500 + i)), lang) for i, lang in enumerate(["ru", "zh"] * 10)]
    docs = spark.createDataFrame([*good, *bad, (9900, None, "ru"), (9901, "", None), good[3], good[3]], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(d, 1) for d, _, _ in good[::2]], "doc_id long, quality int")
    got = judge(docs, labels).collect()
    assert len(got) == docs.count()
    assert np.mean([r["accepted"] for r in got if r["doc_id"] < 9000]) >= 0.97
    assert not any(r["accepted"] for r in got if 9000 <= r["doc_id"] < 9900)
    assert sorted(r["doc_id"] for r in accepted(docs, labels).collect()) == sorted(r["doc_id"] for r in got if r["accepted"])


def test_many_blocks_judge_as_one(spark, monkeypatch):
    docs = fixtures.documents(spark)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 130, 2)], "doc_id long, quality int")
    key = lambda r: tuple((x is None, x) for x in (r["doc_id"], r["lang"], round(r["log_perplexity"], 9), r["accepted"]))
    one = sorted(map(key, judge(docs, labels, least=2).collect()))
    monkeypatch.setattr(perplexity, "BLOCK", 100)
    assert sorted(map(key, judge(docs, labels, least=2).collect())) == one
