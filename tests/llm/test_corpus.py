"""Phrases, manifests and license scans against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartlens.llm import licenses, merkle, phrases
from cartlens.llm.common import documents as columns_of
from cartlens.llm.queries import ORACLE, QUERIES
from tests.compare import differences, duckdb_connection
from tests.llm.data import SCHEMA, SMALL, documents, odd_documents, prose

NEW = ("op11_phrase_collocations", "op12_merkle_manifest", "op13_license_scan")


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), duckdb_connection(SMALL), ORACLE[name]) == []


def rows_of(docs):
    return [tuple(r) for r in columns_of(docs).collect()]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- phrases ---------------------------------------------------------------------------------------


def brute_counts(rows, longest=4):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts, totals


def brute_collocations(rows, least, first):
    counts, totals = brute_counts(rows)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    within = defaultdict(int)
    for (lang, words), a in candidates.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                within[lang, words[i : i + n]] = max(within[lang, words[i : i + n]], a)
    scored = defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * within[lang, words] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (counts[lang, words[:k]] + counts[lang, words[k:]]), k) for k in range(1, len(words)))
        scored[lang].append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return {
        (lang, rank, phrase.decode(), -a, l, r, totals[lang], -score)
        for lang, found in scored.items() for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:first], 1)
    }


def phrase_rows():
    again = "The red-fox JUMPS over, the red-fox jumps over; é É red-fox\tjumps over the\x0bred-fox"
    rows = [(i, again if i % 3 else prose(i, 60, "ab"), ("en", "fr", None)[i % 3 if i % 5 else 0], "a") for i in range(40)]
    rows += [(i, "tick " * 500, "de", "a") for i in range(2)] + [(None, "a b. c d", "und", None), (1, "", "en", "a"), (2, None, None, "a")]
    rows += [(3, prose("long", 4000, "abc"), "en", "a")] + [(4, " .. \t;", "xx", "a")]
    return [(*row, 0) for row in rows]


@pytest.mark.parametrize("least, first", [(2, 2000), (5, 7)])
def test_collocations(spark, least, first):
    rows = phrase_rows()
    found = phrases.collocations(odd_documents(spark, rows), least, first).collect()
    assert {tuple(r) for r in found} == brute_collocations(rows, least, first)
    assert len(found) == len({(r.lang, r["rank"]) for r in found})


def test_full_bit_map_loses_nothing(spark, monkeypatch):
    """With a map of one bit per page nothing is pruned, and counts stay exact."""
    monkeypatch.setattr(phrases, "common_map", lambda chunks, least: np.full(phrases.BITS // 8, 255, np.uint8))
    rows = phrase_rows()
    assert {tuple(r) for r in phrases.collocations(odd_documents(spark, rows), 3, 50).collect()} == brute_collocations(rows, 3, 50)


def test_chunks_hold_every_phrase_once(spark):
    rows = phrase_rows()
    counted = Counter()
    for r in phrases.dictionary(odd_documents(spark, rows)).collect():
        text = bytes(r.text).decode()
        parts = re.split(r"([ \n])", text)
        words, behind = parts[0::2], parts[1::2]
        for n in range(1, 5):
            for i in range(min(r.own, len(words) - n + 1)):
                if "\n" not in behind[i : i + n - 1]:
                    counted[r.lang, tuple(words[i : i + n])] += r.times
    assert counted == brute_counts(rows)[0]


def test_copies_share_chunks(spark):
    text = prose("copies", 400)
    rows = [(i, f"{prose(i, 5)} {text}", "en", "a", 0) for i in range(30)]
    chunks = phrases.dictionary(spark.createDataFrame(rows, SCHEMA))
    assert chunks.agg(F.sum("own")).first()[0] < 30 * 60


# --- manifests -------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, place):
    return [(place >> k & 1, level[place >> k ^ 1] if place >> k ^ 1 < len(level) else None) for k, level in enumerate(levels[:-1])]


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_manifest(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append(row)
    langs = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    ordered = {lang: sorted(trees[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r))) for lang in langs}
    built = {lang: brute_tree([leaf_of(*r) for r in ordered[lang]]) for lang in langs}
    top = brute_tree([built[lang][-1][0] for lang in langs])
    out = Counter()
    for at, lang in enumerate(langs):
        for place, row in enumerate(ordered[lang]):
            way = siblings(built[lang], place) + siblings(top, at)
            altered = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            digest = leaf_of(*row[:4], row[4] + 1) if altered else leaf_of(*row)
            for right, sibling in way:
                digest = sha(digest if sibling is None else sibling + digest if right else digest + sibling)
            proof = sha("".join(s for _, s in way if s is not None))
            out[row[0], leaf_of(*row), built[lang][-1][0], top[-1][0], proof, digest, digest == top[-1][0]] += 1
    return out


@pytest.mark.parametrize("levels", [merkle.LEVELS, 2])
def test_manifest(spark, monkeypatch, levels):
    """Also with slices of two levels: many rounds up and down."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    draw = [(i, prose(i, i % 9), ("en", "fr", None, "é", "z" * (i % 13))[i % 5 if i % 4 else 0], "s", i) for i in range(150)]
    odd = odd_documents(spark)
    docs = columns_of(odd).union(spark.createDataFrame(draw, SCHEMA)).union(spark.createDataFrame([(7, None, None, None, None)] * 2, SCHEMA))
    found = Counter(tuple(r) for r in merkle.verified_manifest(docs).collect())
    assert found == brute_manifest(rows_of(docs))
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(1, "text", "en", "a", 4)], SCHEMA)
    row, = merkle.verified_manifest(one).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("")
    assert merkle.verified_manifest(one.where("false")).collect() == []


# --- licenses --------------------------------------------------------------------------------------

NOTICES = [
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "cc\nby, CC-BY", "the mit\xa0license", "xmit license", "éMIT License",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
    "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal in it",
    "Permission is hereby granted, free of charges, to any person obtaining a copy of this software and associated documentation files the software to deal in",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "gnu general public gnu general public license",
]


def license_rows():
    rows = [(i, f"{prose(i, i % 17)} {notice} {prose(-i, i % 5)}", "en", "a") for i, notice in enumerate(NOTICES * 3)]
    rows += [(100, " ".join(NOTICES), "en", "b"), (101, NOTICES[0] * 200, "en", "b"), (None, NOTICES[1], None, None)]
    rows += [(102, "the this of to software " * 100, "en", "a"), (103, "", "en", "a"), (104, None, "en", "a"), (105, "🙂 İ \x7f a", "en", "a")]
    return [(*row, 0) for row in rows]


def brute_licenses(rows):
    texts = [re.findall(licenses.WORD, lower(text)) for _, text, *_ in rows]
    df = Counter(w for words in texts for w in set(words))
    weight = {w: round(1000 * math.log(1 + (len(rows) + 1) / (df[w] + 1))) for w in licenses.VOCABULARY}
    out = Counter()
    for (doc_id, *_), words in zip(rows, texts):
        base = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        labels, best = {label for _, label in base}, 1.0 if base else 0.0
        for label, passage, key in licenses.TEMPLATES:
            template = passage.split()
            total, (a, b) = sum(weight[w] for w in template), licenses.key_places(passage, key)
            for first in range(1 - len(template), len(words)):
                same = [i for i, w in enumerate(template) if 0 <= first + i < len(words) and words[first + i] == w]
                scored = sum(weight[template[i]] for i in same)
                if 100 * scored >= licenses.LEAST_SCORE * total and set(range(a, b + 1)) <= set(same):
                    labels.add(label)
                    best = max(best, scored / total)
        places = [i for i, _ in base]
        out[doc_id, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best] += 1
    return out


def test_licenses(spark):
    rows = license_rows()
    found = Counter(tuple(r) for r in licenses.license_labels(odd_documents(spark, rows)).collect())
    assert found == brute_licenses(rows)
    assert licenses.license_labels(odd_documents(spark, rows).where("false")).collect() == []


def test_licenses_label_what_base_phrases_do_not_name(spark):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(NOTICES + [prose(i, 50) for i in range(50)])], SCHEMA)
    labels = {r.doc_id: (r.base_labels, r.labels) for r in licenses.license_labels(docs).collect()}
    assert labels[1] == ("cc-by", "cc-by,cc-by-nc") and labels[6] == ("gpl", "gpl,gpl-3.0") and labels[8] == ("", "mit")
    assert labels[9] == ("", "") and labels[10] == ("", "bsd") and labels[4] == labels[5] == ("", "")
    spans = {r.doc_id: [(m.label, m["first"]) for m in r.matches] for r in licenses.scan_licenses(docs).collect()}
    assert spans[7] == [("apache-2.0", 0)]


def test_licenses_run_no_python(spark):
    plan = licenses.license_labels(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert not re.search("Exchange|Join", plan)
