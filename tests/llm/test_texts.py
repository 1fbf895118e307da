"""Deduplication, token counts and packing against brute force."""

import functools
import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartlens.llm import graph, packing, repeats, simhash, substring, suffix, tokens
from cartlens.llm.common import documents as columns_of
from cartlens.llm.queries import BYTE_VOCABULARY, QUERIES, WORD_VOCABULARY
from tests.llm.data import SMALL, documents, odd_documents, odd_rows, prose, words


def rows_of(docs):
    return [(r.doc_id, r.text) for r in columns_of(docs).collect()]


def order(doc_id):
    return (1 << 63) - 1 if doc_id is None else doc_id


def brute_repeats(rows, window, elements):
    """(doc_id, number, removed flags, elements) of each row."""
    first = {}
    for doc_id, text in rows:
        e = elements(text)
        for i in range(len(e) - window + 1):
            at = (order(doc_id), i)
            first[tuple(e[i : i + window])] = min(at, first.get(tuple(e[i : i + window]), at))
    out = []
    for doc_id, text in rows:
        e, gone = elements(text), [False] * len(elements(text))
        for i in range(len(e) - window + 1):
            if first[tuple(e[i : i + window])] < (order(doc_id), i):
                gone[i : i + window] = [True] * window
        out.append((doc_id, e, gone))
    return out


def word_digests(rows, window=20):
    return Counter(
        (d, len(e), sum(g), hashlib.sha256(" ".join(w for w, x in zip(e, g) if not x).encode()).hexdigest())
        for d, e, g in brute_repeats(rows, window, words)
    )


def byte_digests(rows, window=100):
    out = Counter()
    for d, e, g in brute_repeats(rows, window, lambda t: list((t or "").encode())):
        runs = sum(b and not a for a, b in zip([False, *g], g))
        kept = bytes(b for b, x in zip(e, g) if not x)
        out[(d, len(e), sum(g), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def collected(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


WORD_COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")
BYTE_COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_substring_dedup(spark):
    assert collected(QUERIES["op5_seed_extend_dedup"](spark, SMALL), *WORD_COLUMNS) == word_digests(rows_of(documents(spark)))


def test_suffix_dedup(spark):
    small = documents(spark).where("doc_id < 80")
    assert collected(suffix.digest(suffix.suffix_dedup(small)), *BYTE_COLUMNS) == byte_digests(rows_of(small))


@pytest.mark.parametrize("wide, rows", [(repeats.WIDE, repeats.ROWS), (1, 3)])
def test_odd_documents(spark, monkeypatch, wide, rows):
    """Also with every anchor counting as very common, and rows handled three at a time."""
    plain = [row[:2] for row in odd_rows()]
    docs = odd_documents(spark)
    meet = repeats.meet

    def small_meet(batches):  # runs inside the worker
        repeats.WIDE, repeats.ROWS = wide, rows
        yield from meet(batches)

    monkeypatch.setattr(repeats, "meet", small_meet)
    assert collected(substring.digest(substring.substring_dedup(docs)), *WORD_COLUMNS) == word_digests(plain)
    assert collected(suffix.digest(suffix.suffix_dedup(docs)), *BYTE_COLUMNS) == byte_digests(plain)
    monkeypatch.undo()


def test_windows_of_very_common_anchors_do_not_shuffle_the_texts_again(spark, monkeypatch):
    """The texts reach these, the candidates and the cuts by one exchange: nothing is written in between."""
    docs, meet, stage, staged = odd_documents(spark), repeats.meet, repeats.stage, []

    def small_meet(batches):  # runs inside the worker
        repeats.WIDE, repeats.ROWS = 1, 3
        yield from meet(batches)

    def noted(df, name):
        staged.append(name)
        return stage(df, name)

    monkeypatch.setattr(repeats, "meet", small_meet)
    monkeypatch.setattr(repeats, "stage", noted)
    for result in (substring.substring_dedup(docs), suffix.suffix_dedup(docs)):
        assert result.count() == len(odd_rows())
    assert staged == ["met", "met"]


def test_texts_without_an_id_keep_their_own_cuts(spark):
    """A few thousand rows without an id: far more than 16 bits of a hash tell apart."""
    shared = [prose(f"shared {i}", 40) for i in range(5)]
    plain = [(None, " ".join([prose(f"{i} a", i % 7), shared[i % 5] if i % 3 else "", prose(f"{i} b", 25 + i % 11)])) for i in range(3000)]
    plain += [(1, shared[0]), (None, plain[5][1]), (None, None)]
    docs = spark.createDataFrame(plain, "doc_id long, text string").repartition(3)
    assert collected(substring.digest(substring.substring_dedup(docs)), *WORD_COLUMNS) == word_digests(plain)
    assert collected(suffix.digest(suffix.suffix_dedup(docs)), *BYTE_COLUMNS) == byte_digests(plain)


@pytest.mark.parametrize("operator", [substring.substring_dedup, suffix.suffix_dedup])
def test_texts_are_shuffled_once(spark, operator):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = operator(documents(spark))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange") == 1
    assert len([line for line in plan.splitlines() if "FileScan" in line and "documents.parquet" in line]) == 1


def test_segments_hold_all_windows(monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    text = prose("segments", 700).encode()
    for unit in (repeats.Unit(20, 8, True), repeats.Unit(100, 32, False)):
        whole = text.split() if unit.words else list(text)
        seen = set()
        for base, part in unit.segments(text):
            elements = part.split() if unit.words else list(part)
            assert elements == whole[base : base + len(elements)]
            seen |= set(range(base, base + len(elements) - unit.window + 1))
        assert seen == set(range(len(whole) - unit.window + 1))


def test_suffix_array_and_prefixes():
    draw = np.random.default_rng(5)
    for trial in range(150):
        text = np.append(draw.integers(1, draw.integers(2, 5), draw.integers(1, 50)), 0).astype(np.uint16)
        plain = text.tolist()
        expected = sorted(range(len(plain)), key=lambda i: plain[i:])
        found = suffix.suffix_array(text)
        assert found.tolist() == expected
        shared = suffix.common_prefixes(text, found)
        for a, b in zip(expected, expected[1:]):
            n = next(k for k in range(len(plain)) if plain[a + k] != plain[b + k])
            assert shared[b] == n


def test_cut_documents_keeps_whole_characters(spark):
    docs = odd_documents(spark)
    kept = suffix.cut_documents(docs).collect()
    assert all(r.n_chars == len(r.text) > 0 for r in kept)
    assert {r.doc_id for r in kept} == {-3, 3, 6, 7, 8, 9, 11, 12, 13, 14, 10} - {10}


def brute_components(prints):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    listed = sorted(parent)
    for i, a in enumerate(listed):
        for b in listed[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(b)] = root(a)
    return {p: root(p) for p in listed}


def brute_print(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, min(len(w), 1)))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("kind", ["documents", "odd"])
def test_simhash(spark, kind):
    docs = odd_documents(spark) if kind == "odd" else documents(spark)
    rows = rows_of(docs)
    prints = [brute_print(text) for _, text in rows]
    roots = brute_components(prints)
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            least[roots[p]] = min(doc_id, least.get(roots[p], doc_id))
    expected = Counter((d, f"{p:016x}", least.get(roots[p])) for (d, _), p in zip(rows, prints))
    assert collected(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    kept = simhash.one_of_each(docs).collect()
    assert len(kept) == len(set(roots.values()))
    assert {r.doc_id for r in kept if r.doc_id is not None} == set(least.values())


def test_every_close_pair_meets_at_an_anchor():
    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base ^ (np.uint64(1) << draw.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 400).astype(np.uint64))
    prints = np.unique(np.concatenate([base, near]))
    anchor, who, nearest = simhash.anchors_of(prints)
    assert nearest.sum() == len(prints)
    order_ = np.argsort(anchor, kind="stable")
    columns = anchor[order_], prints[who][order_], nearest[order_]
    expected = {(int(a), int(b)) for a in prints for b in prints if a < b and int(a ^ b).bit_count() <= 2}
    for large in (simhash.LARGE, 3):
        simhash.LARGE, before = large, simhash.LARGE
        a, b = simhash.close_pairs(*columns)
        simhash.LARGE = before
        assert {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())} == expected


def family(seed=5, n=400):
    """Fingerprints around one anchor and some others; the pairs of them within two bits."""
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 1 << 63, 1, dtype=np.uint64)[0]
    flips = np.uint64(1) << draw.integers(0, 64, (n, 3)).astype(np.uint64)
    prints = np.unique(np.concatenate([base ^ np.bitwise_or.reduce(flips, axis=1), draw.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    pairs = {(int(a), int(b)) for a in prints for b in prints if a < b and int(a ^ b).bit_count() <= 2}
    return prints, pairs


def test_hot_anchors_are_split(spark, monkeypatch):
    prints, expected = family()
    anchor, who, nearest = simhash.anchors_of(prints)
    sent = spark.createDataFrame(
        pd.DataFrame({"anchor": anchor, "fingerprint": prints[who].view(np.int64), "nearest": nearest})
    )
    assert simhash.split(sent).exceptAll(sent).count() == 0 and simhash.split(sent).count() == sent.count()
    met = simhash.split(sent, hot=60, own=25).toPandas().sort_values(["anchor", "nearest"], ascending=[True, False])
    assert sent.groupBy("anchor").count().agg(F.max("count")).first()[0] > 300
    assert met[met.nearest].groupby("anchor").size().max() <= 60
    columns = met.anchor.to_numpy(), met.fingerprint.to_numpy(), met.nearest.to_numpy()
    batches = [pa.RecordBatch.from_arrays([pa.array(c[at : at + 7]) for c in columns], names=["a", "f", "n"])
               for at in range(0, len(met), 7)]
    for rows in (20, 100_000):
        found = set()
        for part in simhash.whole_groups(iter(batches), rows):
            a, b = simhash.close_pairs(*part)
            found |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
        assert found == expected
    # the same through the whole join
    monkeypatch.setattr(simhash, "split", functools.partial(simhash.split, hot=60, own=25))
    found = graph.components(simhash.links(spark.createDataFrame([(p,) for p in prints.view(np.int64).tolist()], "fingerprint long")))
    linked = graph.components(spark.createDataFrame([tuple(np.array(p, np.uint64).view(np.int64).tolist()) for p in expected], "a long, b long"))
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in linked.collect()}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 50 + i) for i in range(30)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{50 + i: 50 for i in range(30)}, 100: 50, 200: 200, 201: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


ODD = ["", " ", "a  b", "a \n b", "a\n \nb", "it's I'VE we'll 'rx ''s l'l", "a1b22 ٣ ½", "İ ΣΑΣ", "x<|endoftext|>y", "é ̈ a​b\xa0w \x85z",
       "日本語 😀😀", "word" * 3000, " lead", "trail ", "a   b", "\n\n a"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_equal_the_library(spark, name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ODD + [r.text or "" for r in documents(spark).select("text").collect()]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    if name.startswith("word"):
        assert tokens.TokenCounter(public_tokenizers.path(name)).counts(texts) == [len(e) for e in expected]
    else:
        own = packing.Tokenizer(public_tokenizers.path(name))
        assert [np.frombuffer(own.ids(t), "<u4").tolist() for t in texts] == expected


def test_transducer_scan_equals_steps():
    transducer = tokens.Transducer()
    kinds = np.random.default_rng(1).integers(0, transducer.kinds, 5000)
    kinds[-1] = tokens.SPACE
    state, starts = tokens.FRESH, []
    for i, k in enumerate(kinds.tolist()):
        state, emitted = tokens.step(state, k)
        starts += [i - 1] * bool(emitted & tokens.BEFORE) + [i] * bool(emitted & tokens.HERE)
    assert transducer.starts(kinds).tolist() == sorted(starts)


def test_token_counts_of_odd_documents(spark):
    library = Tokenizer.from_file(WORD_VOCABULARY)
    expected = Counter()
    for doc_id, text, *_ in odd_rows():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        expected[(doc_id, len((text or "").encode()), n, n > 2048)] += 1
    assert collected(tokens.token_counts(odd_documents(spark), WORD_VOCABULARY), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert tokens.token_counts(odd_documents(spark, []), WORD_VOCABULARY).collect() == []


@pytest.mark.parametrize("kind", ["documents", "odd", "empty"])
def test_packing(spark, kind):
    docs = {"documents": documents, "odd": odd_documents, "empty": lambda s: odd_documents(s, [])}[kind](spark)
    library = Tokenizer.from_file(BYTE_VOCABULARY)
    expected = Counter()
    for doc_id, text in rows_of(docs):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        start, piece = 0, 0
        while start < len(ids):
            length = (len(ids) - 1) % 2048 + 1 if piece == 0 else 2048
            part = np.array(ids[start : start + length], "<u4")
            expected[(doc_id, piece, start, length, zlib.crc32(part.tobytes()))] += 1
            start, piece = start + length, piece + 1
    packed = packing.pack(docs, BYTE_VOCABULARY, with_ids=True).cache()
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 2048) + 2
    whole = packing.sequences(packed).collect()
    assert len(whole) == len(bins) and sum(len(r.ids) for r in whole) == total


def test_crossover_keeps_every_piece_once():
    draw = np.random.default_rng(4)
    lengths = draw.integers(1, 900, 300)
    people = packing.first_population(lengths, 1000, 4, draw)
    for _ in range(20):
        child = packing.cross(people[0], people[1 + draw.integers(3)], lengths, 1000, draw)
        loads = np.bincount(child, lengths)
        assert child.min() >= 0 and loads.max() <= 1000 and (loads > 0).all()
    best = packing.evolve(people, lengths, 1000, draw)[0]
    assert packing.fitness(best, lengths, 1000) <= min(packing.fitness(p, lengths, 1000) for p in people)


def test_tokens_of_characters_newer_than_python():
    library, counter = Tokenizer.from_file(WORD_VOCABULARY), tokens.compiled(WORD_VOCABULARY)
    newer = [chr(p) for p in (0xA7DC, 0x1C89, 0x105D2, 0x1C8A, 0x10D40, 0x10D4A, 0x11BF0)]
    points = np.flatnonzero(tokens.unknown_points())[::997].tolist()
    texts = [f"it's {c}{c} a{c}1 {c}'ll Σας" for c in [*newer, *map(chr, points)]]
    assert counter.counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
