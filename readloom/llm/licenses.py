"""License scans over a positional rare-token index.

Templates are word sequences with a mandatory key phrase. Each is posted under the rarest words of its whole text, by inverse document
frequency over the corpus, with their positions. Every occurrence of such a word in a file proposes the place where a
template would have to start; a place stands only if enough of the template's indexed words are at their relative positions
(the intersection of the postings) and the key phrase is there word by word. Everything is DataFrame expressions
within a row, so nothing is shuffled but the word counts.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm import kit

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Fixed values: (label, words, base). The mandatory key phrase stands between square brackets; base templates are key phrase only.
TEMPLATES = (
    ("mit", "[under the mit license]", True),
    ("apache-2", "[apache license version 2]", True),
    ("cc-by-nc", "[cc by nc]", True),
    ("mit", "[permission is hereby granted free of charge to any person] obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", False),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www [apache org licenses license 2 0]", False),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted provided that the following conditions are met", False),
    ("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted", False),
    ("gpl-2", "free software you can redistribute it and or modify it under the terms of the [gnu general public license as published by the free software foundation either version 2] of the license", False),
    ("gpl-3", "free software you can redistribute it and or modify it under the terms of the [gnu general public license as published by the free software foundation either version 3] of the license", False),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the [gnu lesser general public license] as published by the free software foundation", False),
    ("agpl-3", "you can redistribute it and or modify it under the terms of the [gnu affero general public license] as published by the free software foundation", False),
    ("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2 0] if a copy of the mpl was not distributed with this file", False),
    ("unlicense", "this is [free and unencumbered software released into the public domain] anyone is free to copy modify publish use compile sell or distribute", False),
    ("cc-by", "licensed under a [creative commons attribution 4 0 international license]", False),
    ("cc-by-sa", "licensed under a [creative commons attribution sharealike 4 0] international license", False),
    ("cc-by-nc", "licensed under a [creative commons attribution noncommercial 4 0] international license", False),
    ("cc0", "to the extent possible under law the author has [waived all copyright and related or neighboring rights] to this work", False),
    ("cc-by-sa", "licensed under [cc by sa] 4 0", False),
    ("all-rights-reserved", "copyright [all rights reserved]", False),
)
#: Words under which a template is posted (at most half of it, at least two), and the share of them that must stand at their places (all of a base template's).
RARE, ENOUGH = 4, 0.75


class Template:
    def __init__(self, label: str, text: str, base: bool) -> None:
        before, _, rest = text.partition("[")
        phrase, _, after = rest.partition("]")
        self.label, self.base, self.phrase, self.at = label, base, phrase.split(), len(before.split())
        self.words = [*before.split(), *self.phrase, *after.split()]
        self.most = max(2, min(RARE, len(self.words) // 2))

    def rare(self, idf: dict[str, float]) -> list[tuple[str, int]]:
        """The rarest words of the whole template with their first positions."""
        first = {w: k for k, w in reversed(list(enumerate(self.words)))}
        return sorted(first.items(), key=lambda x: (-idf[x[0]], x[1]))[: self.most]

    def enough(self, rare: list) -> int:
        return len(rare) if self.base else math.ceil(ENOUGH * len(rare))


def words_of(text):
    return F.array_remove(F.split(kit.lower_az(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """Inverse document frequency of each licence word over all documents (the driver gets one row per licence word)."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    rows = docs.select(F.array_intersect(words_of(F.col("text")), known).alias("w"))
    total = rows.select(F.explode(F.concat(F.col("w"), F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    n = {r["w"]: r["count"] for r in total}
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) + 1e-9 for w in vocabulary}


def _starts(w, t: Template, rare: list[tuple[str, int]]):
    """Where the template starts: the places that its indexed words propose, at which enough of them stand, and the key phrase does."""

    def proposed(word: str, at: int):
        return F.transform(F.filter("places", lambda i: F.get(w, i) == word), lambda i: i - at)

    def stands(start):
        there = sum((F.when(F.get(w, start + k) == x, 1).otherwise(0) for x, k in rare), F.lit(0))
        first = start + t.at
        return (first >= 0) & (there >= t.enough(rare)) & (F.slice(w, F.greatest(first + 1, F.lit(1)), len(t.phrase)) == F.array(*[F.lit(x) for x in t.phrase]))

    return F.filter(F.array_distinct(F.concat(*[proposed(*r) for r in rare])), stands)


def _share(w, t: Template, idf: dict[str, float]):
    """The share of the template's weight that stands at a start."""
    whole = sum(idf[x] for x in t.words)

    def share(start):
        got = F.lit(0.0)
        for p, x in enumerate(t.words):
            got = got + F.when(F.get(w, start + p) == x, idf[x]).otherwise(0.0)
        return got / whole

    return share


def scan(docs: DataFrame, templates=TEMPLATES, keep: list[str] | None = None) -> DataFrame:
    """Find licence labels. Returns (row, n_words, n_base, first_word, last_word, base_labels, labels, score); ``row`` is a struct of the input's columns (or of ``keep``).

    Base templates count every place; the others add labels where enough of their indexed words and their key phrase stand. score is
    the largest share of a template's summed inverse document frequency that stands at its relative positions, 0 if nothing was found. Null text is empty; repeated
    rows get equal results; an empty table gives no rows.
    """
    made = [Template(*t) for t in templates]
    vocabulary = sorted({w for t in made for w in t.words})
    idf = frequencies(docs, vocabulary)
    row = F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("row")
    rare = [t.rare(idf) for t in made]
    anchors = sorted({x for r in rare for x, _ in r})
    rows = docs.select(row, words_of(F.col("text")).alias("w"))
    anchor = F.array(*[F.lit(a) for a in anchors])
    places = F.when(F.arrays_overlap("w", anchor), F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("w", i).isin(anchors))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("places", places)
    w = F.col("w")
    starts = [_starts(w, t, r) for t, r in zip(made, rare)]
    rows = rows.select("row", "w", *[s.alias(f"s{k}") for k, s in enumerate(starts)])
    base = F.concat(*[F.col(f"s{k}") for k, t in enumerate(made) if t.base], F.array().cast("array<int>"))

    def labels(of):
        found = F.array(*[F.when(F.size(f"s{k}") > 0, t.label) for k, t in of])
        return F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",")

    score = F.lit(0.0)
    for k, t in enumerate(made):
        score = F.greatest(score, F.when(F.size(f"s{k}") > 0, F.least(F.lit(1.0), F.array_max(F.transform(f"s{k}", _share(w, t, idf))))).otherwise(0.0))
    numbered = list(enumerate(made))
    return rows.withColumn("b", base).select(
        "row", F.size("w").cast("long").alias("n_words"), F.size("b").cast("long").alias("n_base"),
        F.array_min("b").cast("long").alias("first_word"), F.array_max("b").cast("long").alias("last_word"),
        labels([x for x in numbered if x[1].base]).alias("base_labels"), labels(numbered).alias("labels"), score.alias("score"),
    )


def op7(spark, sf_dir):
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def oracle(templates=TEMPLATES) -> str:
    """The same rows by brute force: every start of every template that any of its rare words lines up with."""
    made = [Template(*t) for t in templates]
    words = ", ".join(f"({k}, {p}, '{w}')" for k, t in enumerate(made) for p, w in enumerate(t.words))
    shapes = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {t.at}, {t.phrase}, {t.most})" for k, t in enumerate(made))
    az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{az}', '{az.lower()}'), '{SEPARATORS}'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT * FROM (VALUES {shapes}) AS x (t, label, base, off, phrase, most)),
v AS (SELECT * FROM (VALUES {words}) AS x (t, p, word)),
k AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
n AS (SELECT word, count(DISTINCT r) AS n FROM k WHERE word IN (SELECT word FROM v) GROUP BY word),
f AS (SELECT word, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))::DOUBLE) + 1e-9 AS idf FROM (SELECT DISTINCT word FROM v) LEFT JOIN n USING (word)),
u AS (SELECT t, word, min(p) AS p FROM v GROUP BY t, word),
rare AS (SELECT t, word, p FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY idf DESC, p) AS o FROM u JOIN f USING (word)) JOIN t USING (t) WHERE o <= most),
need AS (SELECT t, CASE WHEN base THEN count(*) ELSE ceil({ENOUGH} * count(*)) END AS need FROM rare JOIN t USING (t) GROUP BY t, base),
s AS (SELECT r, t, i - p AS start FROM k JOIN rare USING (word) JOIN need USING (t) GROUP BY r, t, i - p, need HAVING count(*) >= need),
m AS (SELECT s.r, s.t, s.start, label, base, w FROM s JOIN t USING (t) JOIN d ON d.r = s.r WHERE start + off >= 0 AND w[start + off + 1 : start + off + len(phrase)] = phrase),
g AS (SELECT m.r, m.t, m.start, sum(CASE WHEN start + p >= 0 AND w[start + p + 1] = word THEN idf ELSE 0 END) / sum(idf) AS share FROM m JOIN v USING (t) JOIN f USING (word) GROUP BY m.r, m.t, m.start),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(least(1.0, coalesce((SELECT max(share) FROM g WHERE g.r = d.r), 0)), 6) AS score
FROM d LEFT JOIN a USING (r)
"""


ORACLE_SQL = oracle()
