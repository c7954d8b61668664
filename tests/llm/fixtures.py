"""Small tables with the cases every operator has to stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

DOCS = "doc_id long, text string, lang string, source string, start string, part int, size double, shard string, row string, label string"


def prose(seed, words):
    r = random.Random(seed)
    return " ".join(r.choice("the of and station Morning cold river über école señor 12 runs; house. tree, light stone far".split()) for _ in range(words))


def rows():
    texts = [None, "", " ", "a", "Ab ab AB", "x\n\ny  z", "  lead", "trail \n", "naïve café Ünder", "!!!", "12 34", "The MIT. under the MIT license", "\x1c tab\tend　wide"]
    texts += [prose(i, n) for i, n in enumerate([3, 5, 8, 40, 41, 90, 300, 5000])]
    texts += [prose(3, 40), prose(3, 40) + " tail", prose(6, 300).replace("river", "stream", 1)]
    out = [(i, t, ["en", "de", None][i % 3], ["a", "b", None][i % 3], "s", i, 0.5, "z", "r", "l") for i, t in enumerate(texts)]
    out += [out[5], out[16], (None, "no id", None, None, None, None, None, None, None, None), (None, None, "en", "a", None, None, None, None, None, None)]
    out += [(100 + i, prose(77, 30), "en", "hot", "s", 1, 1.0, "z", "r", "l") for i in range(30)]
    return out


def documents(spark, parts=5):
    return spark.createDataFrame(rows(), DOCS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOCS)
