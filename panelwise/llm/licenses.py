"""Licence scans: rare words of licence templates point to places, which are then verified."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, UPPER, ascii_lower

#: Everything between words: ASCII characters other than digits and lower-case letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases that have to stand at their place in the template, word for word.
    phrases: tuple[str, ...]
    #: Least share of the template's IDF weight at its place.
    share: float = 0.8

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def offsets(self) -> list[tuple[int, list[str]]]:
        out = []
        for phrase in self.phrases:
            p = phrase.split()
            out.append((next(i for i in range(len(self.words)) if self.words[i : i + len(p)] == p), p))
        return out


#: The phrases whose places are counted, with their labels.
BASE = [
    Template("mit", "under the mit license", ("under the mit license",), 1.0),
    Template("apache-2", "apache license version 2", ("apache license version 2",), 1.0),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), 1.0),
]
#: Openings of public licence notices.
NOTICES = [
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
]


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), lambda w: w != "")


def idf(rows: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """ln(1 + rows / (1 + rows with the word)) of every licence word, over all rows."""
    seen = rows.select(F.explode(F.filter(F.array_distinct("_words"), lambda w: w.isin(vocabulary))).alias("w"))
    found = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}  # licence words only
    n = rows.count()
    return {w: math.log(1 + n / (1 + found.get(w, 0))) for w in vocabulary}


def anchors(template: Template, weight: dict[str, float]) -> list[str]:
    """Rarest words of a template, so many that no place with its share of the weight lacks all of them."""
    words = template.words
    spare = (1 - template.share) * sum(weight[w] for w in words) + 1e-9
    out: list[str] = []
    for w in sorted(set(words), key=lambda w: (-weight[w], w)):
        out.append(w)
        spare -= weight[w] * words.count(w)
        if spare < 0:
            break
    return out


def scan(docs: DataFrame, notices: list[Template] | None = None, base: list[Template] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A text (null: empty) in lower case (A-Z only) is a list of words. Of each template the words with the highest IDF
    in this corpus are its anchors. Where a file has an anchor, the anchor's place in the template gives the place at
    which the template would begin; there the share of the template's IDF weight that matches is summed and its key
    phrases are verified. Anchors hold more weight than a match may miss, so no place is lost. ``n_base`` counts
    all places of ``base`` phrases; ``score`` is the highest share of a verified template, 0 without any. Rows are
    independent of each other: null or repeated doc_ids are scanned like others, other columns are ignored.
    """
    base, notices = BASE if base is None else base, NOTICES if notices is None else notices
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("_words"))
    weight = idf(rows, sorted({w for t in base + notices for w in t.words}))
    rare = {t: anchors(t, weight) for t in base + notices}
    look = sorted({w for a in rare.values() for w in a})
    size = F.size("_words")
    hits = F.filter(F.sequence(F.lit(0), size - 1), lambda i: F.get("_words", i).isin(look))
    rows = rows.withColumn("_hits", F.when(size > 0, hits).otherwise(F.array().cast("array<int>")))

    def starts(t: Template) -> Column:
        at = lambda w: F.filter("_hits", lambda p: F.get("_words", p) == w)
        less = lambda places, k: F.transform(places, lambda p: p - k)
        lists = [less(at(w), k) for w in rare[t] for k, own in enumerate(t.words) if own == w]
        return F.filter(F.array_distinct(F.flatten(F.array(*lists))), lambda s: s >= 0)

    def found(t: Template) -> Column:
        """array of (start, share), verified."""
        own, weights = F.array(*map(F.lit, t.words)), F.array(*[F.lit(weight[w]) for w in t.words])
        total = sum(weight[w] for w in t.words)

        def share(s: Column) -> Column:
            add = lambda a, j: a + F.when(F.get("_words", s + j) == F.get(own, j), F.get(weights, j)).otherwise(F.lit(0.0))
            return F.aggregate(F.sequence(F.lit(0), F.lit(len(t.words) - 1)), F.lit(0.0), add) / F.lit(total)

        def stands(s: Column) -> Column:
            ok = F.lit(True)
            for at, phrase in t.offsets():
                ok &= F.slice("_words", s + at + 1, F.lit(len(phrase))) == F.array(*map(F.lit, phrase))
            return ok

        scored = F.transform(F.filter(starts(t), stands), lambda s: F.struct(s.alias("start"), share(s).alias("share")))
        return F.filter(scored, lambda x: x["share"] >= F.lit(t.share - 1e-9))

    rows = rows.select("doc_id", size.cast("long").alias("n_words"), *[found(t).alias(f"_t{i}") for i, t in enumerate(base + notices)])
    places = F.concat(*[F.transform(f"_t{i}", lambda x: x["start"]) for i in range(len(base))])
    names = lambda ids: F.array_join(
        F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"_t{i}") > 0, F.lit((base + notices)[i].label)) for i in ids]), lambda x: x.isNotNull()))), ","
    )
    every = range(len(base + notices))
    best = F.array_max(F.concat(*[F.transform(f"_t{i}", lambda x: x["share"]) for i in every]))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        names(range(len(base))).alias("base_labels"),
        names(every).alias("labels"),
        F.least(F.lit(1.0), F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def scan_sql(notices: list[Template] = NOTICES, base: list[Template] = BASE) -> str:
    """The scan in SQL: every place of every template that shares a word with the text is weighed."""
    every = base + notices
    template = ", ".join(f"({i}, {j}, '{w}')" for i, t in enumerate(every) for j, w in enumerate(t.words))
    kinds = ", ".join(f"({i}, '{t.label}', {t.share}::DOUBLE, {str(t in base).lower()})" for i, t in enumerate(every))
    phrases = ", ".join(f"({i}, {at}, {p!r})" for i, t in enumerate(every) for at, p in t.offsets())
    return f"""
WITH template(t, j, word) AS (VALUES {template}),
kinds(t, label, least, base) AS (VALUES {kinds}),
phrases(t, off, phrase) AS (VALUES {phrases}),
split AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
located AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM split),
hits AS (SELECT * FROM located WHERE word IN (SELECT word FROM template)),
df AS (SELECT word, count(DISTINCT r) AS n FROM hits GROUP BY word),
weights AS (
  SELECT DISTINCT word, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / (1 + coalesce(n, 0))) AS weight
  FROM template LEFT JOIN df USING (word)),
totals AS (SELECT t, sum(weight) AS total FROM template JOIN weights USING (word) GROUP BY t),
shares AS (
  SELECT r, t, i - j AS start, sum(weight) / any_value(total) AS share
  FROM hits JOIN template USING (word) JOIN weights USING (word) JOIN totals USING (t)
  WHERE i >= j GROUP BY r, t, i - j),
likely AS (SELECT shares.*, label, base FROM shares JOIN kinds USING (t) WHERE share >= least - 1e-9),
verified AS (
  SELECT l.r, l.t, l.start, any_value(l.share) AS share, any_value(l.label) AS label, any_value(l.base) AS base
  FROM likely l JOIN split s USING (r) JOIN phrases p USING (t)
  GROUP BY l.r, l.t, l.start HAVING bool_and(s.w[l.start + p.off + 1 : l.start + p.off + len(p.phrase)] = p.phrase)),
summed AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM verified GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(least(1.0, coalesce(score, 0.0)), 6) AS score
FROM split LEFT JOIN summed USING (r)
"""
