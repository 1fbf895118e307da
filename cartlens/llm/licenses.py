"""License scan by a positional index of rare licence words, in DataFrame functions alone.

Templates are short passages of well-known licence notices, each with a mandatory key phrase. The index lists
for every word of theirs its postings (template, place): a few hundred, whatever the corpus holds. One scan of
the texts keeps, per document, the places of these words alone (`hits`, written down). How many documents hold
each word gives its weight, the inverse document frequency over all rows.

1. Look-up. A template's probes are its places of the highest weight, as many as weigh more together than a match
   may lack. So every match agrees with one of them at least, and a file's other words are not looked up.
2. Intersection. A probe at place p of the file and at place t of the template has the template begin at p - t;
   the words of the file near p are held against the template's postings relative to that beginning.
3. Verification. There is a match where at least LEAST_SCORE percent of the template's weight agrees and its key
   phrase stands whole. The template's label is given and the share of the weight is the match's score.

Base phrases are places where their words stand consecutively. `score` is the best of a document's matches, 1 where
a base phrase stands, 0 without either. Null and empty texts have no words, null places, empty labels and score 0.
All steps after the scan are expressions on one row, so no key can be hot; only the counts of the index words
(a few hundred) reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import pick, stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Passages of public licence notices in lower case without punctuation: label, passage, key phrase.
TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "endorse or promote products derived from this software"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc0", "to the extent possible under law has waived all copyright and related or neighboring rights to this work", "related or neighboring rights"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]

# Percent of a template's weight that a match must have.
LEAST_SCORE = 60

LONGEST = max(len(passage.split()) for _, passage, _ in TEMPLATES)
VOCABULARY = sorted({word for text in [*BASE, *(passage for _, passage, _ in TEMPLATES)] for word in text.split()})


def key_places(passage: str, key: str) -> tuple[int, int]:
    """The first and the last place of a template's key phrase."""
    before = f" {passage} ".index(f" {key} ")
    first = len(passage[:before].split())
    return first, first + len(key.split()) - 1


def _places(array: Column, wanted) -> Column:
    """The positions of `array` for which `wanted` holds."""
    return F.when(F.size(array) > 0, F.filter(F.sequence(F.lit(0), F.size(array) - 1), wanted)).otherwise(F.array().cast("array<int>"))


def _base_places(hits: Column) -> Column:
    """struct(place, label) of all base phrases."""

    def of(phrase: str, label: str) -> Column:
        words = phrase.split()

        def stands(j: Column) -> Column:
            start = F.get(hits, j)
            whole = start["word"] == words[0]
            for m, word in enumerate(words[1:], 1):
                whole = whole & (F.get(hits, j + m)["word"] == word) & (F.get(hits, j + m)["place"] == start["place"] + m)
            return whole

        return F.transform(_places(hits, stands), lambda j: F.struct(F.get(hits, j)["place"].alias("place"), F.lit(label).alias("label")))

    return F.concat(*[of(phrase, label) for phrase, label in BASE.items()])


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def indexed(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, hits (word and place of every index word) and base (place, label) of every row, written down."""
    words = F.col("words")
    rows = pick(docs, doc_id="long", text="string").select(
        "doc_id", F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("words")
    )
    known = _places(words, lambda i: F.get(words, i).isin(VOCABULARY))
    hits = F.transform(known, lambda i: F.struct(F.get(words, i).alias("word"), i.alias("place")))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    return stage(rows.withColumn("base", _base_places(F.col("hits"))), "license-words")


def weights(rows: DataFrame) -> dict[str, int]:
    """Weight of every index word: 1000 times its inverse document frequency, in whole numbers."""
    total = rows.count()
    held = rows.select(F.explode(F.array_distinct("hits.word")).alias("word")).groupBy("word").count()
    counts = {row["word"]: row["count"] for row in held.collect()}
    return {word: round(1000 * math.log(1 + (total + 1) / (counts.get(word, 0) + 1))) for word in VOCABULARY}


def probes(weight: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, template, place) of the places that are looked up."""
    out = []
    for t, (_, passage, _) in enumerate(TEMPLATES):
        words = passage.split()
        spare = 100 * sum(weight[w] for w in words) - LEAST_SCORE * sum(weight[w] for w in words)
        for place in sorted(range(len(words)), key=lambda i: (-weight[words[i]], i)):
            out.append((words[place], t, place))
            spare -= 100 * weight[words[place]]
            if spare < 0:
                break
    return out


def _matches(hits: Column, weight: dict[str, int]) -> Column:
    """struct(label, first, n, score) of all matches."""
    looked_up = probes(weight)
    postings = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(t).alias("template"), F.lit(p).alias("place")) for w, t, p in looked_up])
    passages = [passage.split() for _, passage, _ in TEMPLATES]
    keys = [key_places(passage, key) for _, passage, key in TEMPLATES]

    def by_template(values) -> Column:
        return F.array(*[F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in values])

    words, points = by_template(passages), by_template([[weight[w] for w in words] for words in passages])
    totals = by_template([sum(weight[w] for w in words) for words in passages])
    first_key, last_key = by_template([a for a, _ in keys]), by_template([b for _, b in keys])
    labels, sizes = by_template([label for label, _, _ in TEMPLATES]), by_template([len(words) for words in passages])

    def begins(j: Column) -> Column:
        here = F.get(hits, j)
        return F.transform(
            F.filter(postings, lambda p: p["word"] == here["word"]),
            lambda p: F.struct(p["template"].alias("template"), (here["place"] - p["place"]).alias("first"), j.alias("j")),
        )

    def compared(c: Column) -> Column:
        near = F.slice(hits, F.greatest(c["j"] - LONGEST + 1, F.lit(1)), F.lit(2 * LONGEST))
        agreeing = F.filter(near, lambda h: F.get(F.get(words, c["template"]), h["place"] - c["first"]) == h["word"])
        return F.struct(c["template"].alias("template"), c["first"].alias("first"), F.transform(agreeing, lambda h: h["place"] - c["first"]).alias("places"))

    def judged(m: Column) -> Column:
        t = m["template"]
        scored = F.aggregate(m["places"], F.lit(0), lambda total, p: total + F.get(F.get(points, t), p))
        in_key = F.size(F.filter(m["places"], lambda p: p.between(F.get(first_key, t), F.get(last_key, t))))
        sound = (in_key == F.get(last_key, t) - F.get(first_key, t) + 1) & (scored * 100 >= F.get(totals, t) * LEAST_SCORE)
        return F.when(sound, F.struct(
            F.get(labels, t).alias("label"), m["first"].alias("first"), F.get(sizes, t).alias("n"), (scored / F.get(totals, t)).alias("score")
        ))

    sought = _places(hits, lambda j: F.get(hits, j)["word"].isin(sorted({w for w, _, _ in looked_up})))
    found = F.transform(F.transform(F.flatten(F.transform(sought, begins)), compared), judged)
    return F.array_distinct(F.filter(found, lambda m: m.isNotNull()))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (place and label of every base phrase) and matches (label, first word, words of the
    template, score) of every row."""
    rows = indexed(docs)
    return rows.select("doc_id", "n_words", "base", _matches(F.col("hits"), weights(rows)).alias("matches"))


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    base, places, matches = F.col("base"), F.col("base.place").cast("array<long>"), F.col("matches")
    score = F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.score"), F.lit(0.0)))
    return scan_licenses(docs).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), _joined(base["label"]).alias("base_labels"),
        _joined(F.concat(base["label"], matches["label"])).alias("labels"), score.alias("score"),
    )
