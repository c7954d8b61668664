import math
import re

from panelwise.llm.licenses import BASE, NOTICES, scan

from . import fixtures


def brute(rows):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")) for r in rows]
    n = len(rows)
    df = {}
    for w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for r, w in zip(rows, words, strict=True):
        base, labels, starts, score = set(), set(), [], 0.0
        for t in BASE + NOTICES:
            weight = [math.log(1 + n / (1 + df.get(x, 0))) for x in t.words]
            for s in range(len(w)):
                share = sum(v for x, v, y in zip(t.words, weight, w[s:], strict=False) if x == y) / sum(weight)
                if share >= t.share - 1e-9 and all(w[s + o : s + o + len(p)] == p for o, p in t.offsets()):
                    labels.add(t.label)
                    score = max(score, share)
                    if t in BASE:
                        base.add(t.label)
                        starts.append(s)
        out.append((r["doc_id"], len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(min(1.0, score), 6)))
    return out


def test_against_all_places(spark):
    texts = [t.text for t in BASE + NOTICES]
    texts += ["Released under the MIT License. And again: under the MIT-license!", "mit license under the", "MIT " * 500 + "under the mit license", "cc-by-nc, CC BY NC; cc by-nc by nc"]
    texts += [NOTICES[0].text.replace("person", "human"), "x " + NOTICES[3].text.replace("work", "text") + " y", NOTICES[4].text.replace("redistribute", "share").replace("modify", "alter"), NOTICES[4].text[40:]]
    docs = fixtures.documents(spark).select("doc_id", "text", "label").union(spark.createDataFrame([(500 + i, t, "label") for i, t in enumerate(texts)], "doc_id long, text string, label string"))
    got = [tuple(r)[:7] + (round(r["score"], 6),) for r in scan(docs).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(docs.collect()), key=key)
    assert sum(r[2] for r in got) > 6


def test_empty_table(spark):
    assert scan(fixtures.empty(spark)).count() == 0
