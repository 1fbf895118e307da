"""Mixing, language ID, toxicity, quality rules, neighbours and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartlens.llm import ann, langid, mixing, quality, toxicity
from cartlens.llm.common import documents as columns_of
from cartlens.llm.common import read
from cartlens.llm.queries import ORACLE, QUERIES
from tests.compare import differences, duckdb_connection
from tests.llm.data import SCHEMA, SMALL, documents, odd_documents, odd_rows, prose, words

MEDIUM = "/root/testdata/sf0.01"


# --- mixing ------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values()) * 3 // 2
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * share >= 2 * sizes[s]}
        if not above:
            target |= {s: weight[s] * share for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        open_ -= above
    return target


@pytest.mark.parametrize("kind", ["documents", "odd"])
def test_mix(spark, kind):
    docs = documents(spark) if kind == "documents" else odd_documents(spark)
    plain = [(r.doc_id, len(words(r.text)), r.source) for r in columns_of(docs).collect()]
    rows = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size, r.source) for r in rows) == Counter(plain)
    sizes = defaultdict(int)
    for _, size, source in plain:
        sizes[source] += size
    expected = brute_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, expected[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source, goal in expected.items():
        largest = max(size for _, size, s in plain if s == source)
        assert abs(taken[source] - goal) <= max(2 * largest, 1)
    assert Counter(map(tuple, mixing.mix(docs).collect())) == Counter(map(tuple, rows))


def test_mix_equals_sql(spark):
    connection = duckdb_connection(MEDIUM)
    assert differences(QUERIES["op1_pareto_mix"](spark, MEDIUM), connection, ORACLE["op1_pareto_mix"]) == []


def test_mix_of_nothing(spark):
    assert mixing.mix(odd_documents(spark, [])).collect() == []


def test_mixed_documents_repeat(spark):
    docs = odd_documents(spark)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[(r.doc_id, r.size)] += r.copies
    found = Counter((r.doc_id, len(words(r.text))) for r in mixing.mixed_documents(docs).collect())
    assert found == +copies


# --- language ID and toxicity ------------------------------------------------------------------


def test_language_held_out(spark):
    rows = QUERIES["op2_language_id"](spark, MEDIUM).join(read(spark, MEDIUM, "documents").select("doc_id", "lang"), "doc_id")
    right = [r.lang == r.lang_pred for r in rows.collect() if r.held_out]
    assert np.mean(right) > 0.95


def test_language_of_odd_documents(spark):
    rows = odd_rows() + [(1000 + i, prose(i, 80, "aeiou" if i % 2 else "zxkv"), "l1" if i % 2 else "l2", "a", 0) for i in range(200)]
    found = {}
    for r in langid.language_id(odd_documents(spark, rows)).collect():
        found.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1
    assert sum(map(len, found.values())) == len(rows)
    for none in (1, 2, 7, 14):
        assert [(r.lang_pred, r.score) for r in found[none]] == [("und", 0.0)]
    assert np.mean([found[i][0].lang_pred == ("l1" if i % 2 else "l2") for i in range(1000, 1200)]) > 0.95
    assert langid.language_id(odd_documents(spark, [])).collect() == []
    unlabelled = columns_of(odd_documents(spark)).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_id(unlabelled).collect()} == {"und"}


def test_known_language_of_many_or_none(spark):
    """Ten languages, the best with 2 / 11: above an even share. Nothing learned: whatever has a letter stays."""
    width = len(langid.WIDTHS) * langid.FILTERS
    tables = {w: np.zeros((w, 256, langid.FILTERS), np.float32) for w in langid.WIDTHS}
    offset = np.log(np.array([2.0] + [1.0] * 9))
    network = langid.Network([f"l{i}" for i in range(10)], tables, np.zeros(width), np.zeros((width, 10)), offset)
    docs = odd_documents(spark)
    lettered = sorted(str(text) for _, text, *_ in odd_rows() if text and re.search(r"[^\W\d_]", text))
    for learned in (network, None):
        assert sorted(r.text for r in langid.with_known_language(docs, learned).collect()) == lettered
    network.offset = np.zeros(10)
    assert langid.with_known_language(docs, network).collect() == []


def test_network_pairs_equal_plain_filters():
    draw = np.random.default_rng(0)
    windows = draw.integers(1, 256, (5, langid.WINDOW), dtype=np.uint8)
    network = langid.fit(windows, np.array([0, 1, 0, 1, 0]), ["x", "y"], epochs=1)
    pooled = []
    for w in langid.WIDTHS:
        t = network.tables[w]
        pooled.append(sum(t[k][windows[:, k : k + langid.PLACES]] for k in range(w)).max(axis=1))
    plain = np.maximum(np.concatenate(pooled, axis=1) + network.bias, 0) @ network.weights + network.offset
    assert np.allclose(plain, network.logits(windows), atol=1e-4)


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    marked = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = [r for r in QUERIES["op4_toxicity"](spark, sf_dir).join(marked, "doc_id").collect() if r.held_out]
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    # About a tenth of the toxic labels are on documents without a toxic word.
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_toxicity_of_odd_documents(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id long, toxic int, quality int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(odd_documents(spark, []), labels.limit(0)).collect() == []


def test_samples_stay_bounded_with_a_hot_id(spark, monkeypatch):
    """One learnable id holds a third of all rows: it still gives one text to either sample."""
    hot = next(i for i in range(100) if not zlib.crc32(str(i).encode()) % 5 == 0)
    ids = [i for i in range(100, 500) if zlib.crc32(str(i).encode()) % 5]
    rows = [(hot, f"vile {i} words", "en", "a", 0) for i in range(2000)] + [(i, prose(i, 30), ("en", "fr")[i % 2], "a", 0) for i in ids for _ in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i == hot or i % 3 == 0)) for i in [hot, *ids]], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "learned_lexicon", lambda sample: seen.append(sample.count()) or toxicity.Lexicon({}))
    toxicity.toxicity_model(docs, labels, 10)
    assert seen[0] <= 20
    windows, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, *more: windows.append(len(x)) or fit(x, *more, epochs=1))
    langid.language_model(docs, per_language=50)
    assert windows[0] <= 2 * 50 * langid.WINDOWS


def test_isotonic_is_monotone():
    draw = np.random.default_rng(1)
    raw = draw.normal(size=500)
    y = (draw.random(500) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    x, p = toxicity.isotonic(raw, y, np.ones(500))
    assert (np.diff(x) > 0).all() and (np.diff(p) > 0).all() and math.isclose(np.interp(raw, x, p).mean(), y.mean(), abs_tol=0.05)


def test_trees_learn_an_interaction():
    draw = np.random.default_rng(2)
    x = draw.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = toxicity.boost(x, y, np.ones(2000))
    assert ((trees.sums(x) > 0) == (y > 0)).mean() > 0.97


def test_obfuscated_words_are_found():
    assert toxicity.obfuscated("an 1d1ot m0ron! s*cum ok. no") == ["1d1ot", "m0ron!", "s*cum"]
    lexicon = toxicity.Lexicon({})
    names = dict(zip(toxicity.FEATURES, toxicity.features(lexicon, "You are a m0ron, you IDIOT!!!")))
    assert names["obfuscated_insults"] > 0 and names["near_you"] > 0 and names["insults"] > 0


# --- quality rules -----------------------------------------------------------------------------


def brute_counts(text):
    w = words(text)
    times = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if words(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("kind", ["documents", "odd"])
def test_quality_counts(spark, kind):
    docs = odd_documents(spark) if kind == "odd" else documents(spark)
    expected = Counter()
    for r in columns_of(docs).collect():
        counts = brute_counts(r.text)
        expected[(r.doc_id, *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])] += 1
    found = quality.quality(docs).collect()
    assert Counter((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed) for r in found) == expected
    assert not any(r.kept for r in found if r.base_failed)


def brute_distances(x):
    """The estimate of one pool from the same two starts, in numpy."""
    floors = np.diag(np.square(quality.FLOORS))
    middle = np.sort(x, axis=0)[(len(x) - 1) // 2]
    apart = np.sort(np.abs(x - middle), axis=0)[(len(x) - 1) // 2]
    best = None
    for mean, cov in ((middle, np.diag((apart * 1.4826) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True))):
        for _ in range(quality.STEPS + 1):
            inverse = np.linalg.inv(cov + floors)
            d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
            volume = np.linalg.slogdet(cov + floors)[1]
            last = (volume, d)
            classes = np.floor(np.log2(np.maximum(d, 1e-6)) * quality.CLASSES)
            inside = x[classes <= np.sort(classes)[math.ceil(len(x) * quality.COVERED) - 1]]
            mean, cov = inside.mean(axis=0), np.cov(inside.T, bias=True)
        best = last if best is None or last[0] < best[0] - 1e-9 else best
    return best[1]


def test_robust_distances_equal_numpy(spark):
    """One pool; every tenth document is full of symbols and must not widen the estimate."""
    rows = []
    for i in range(300):
        w = prose(i, 60 + i % 50, "abcdefghijklmnop").split()
        rows.append((i, " ".join(word + "#$%" * (i % 10 == 0) for word in w), "en", "a", 0))
    rows += [(1000 + i, prose(i, 70), "xx", "few", 0) for i in range(5)]
    found = {r.doc_id: r for r in quality.quality(odd_documents(spark, rows)).collect()}
    x = []
    for i in range(300):
        n, chars, symbols, lines, repeats = brute_counts(rows[i][1])
        v = [math.log(n), math.log(chars / n), *(math.log1p(c * 100 / n) for c in (symbols, lines, repeats))]
        x.append(np.round(np.array(v) * quality.UNIT) / quality.UNIT)
    scale = quality.COVERED / quality.chi_square_cdf(quality.chi_square_quantile(quality.COVERED, 5), 7)
    expected = brute_distances(np.array(x)) / scale
    assert np.allclose([found[i].distance for i in range(300)], expected, rtol=1e-3, atol=1e-3)
    assert [i for i in range(300) if not found[i].kept] == list(range(0, 300, 10))
    # Too few of their kind: nothing to compare with.
    assert all(found[1000 + i].kept and found[1000 + i].distance is None for i in range(5))


def test_quality_runs_no_python(spark):
    plan = quality.measured(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.quality(odd_documents(spark, [])).collect() == []


def test_chi_square():
    assert math.isclose(quality.chi_square_quantile(0.95, 5), 11.0705, abs_tol=1e-3)
    assert math.isclose(quality.chi_square_cdf(4.3515, 5), 0.5, abs_tol=1e-4)


# --- nearest neighbours ------------------------------------------------------------------------


def test_recall(spark):
    rows = QUERIES["op9_adaptive_scan"](spark, MEDIUM).collect()
    table = read(spark, MEDIUM, "embeddings").toPandas()
    x, ids = np.stack(table["embedding"]).astype(float), table["vec_id"].to_numpy()
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        mine = found[ids[i]]
        hits += len({v for v, _ in mine} & set(best))
        assert mine == sorted(mine, key=lambda p: (-p[1], p[0])) and len(mine) == 20 and ids[i] not in dict(mine)
        at = dict(zip(ids, scores))
        assert all(math.isclose(s, at[v], rel_tol=1e-9) for v, s in mine)
    assert hits / (20 * len(found)) >= 0.9 and len(found) == (ids % 20 == 0).sum()


def test_odd_vectors(spark):
    """Ties of equal vectors go to the smaller id; unusable vectors take no part; few candidates are all found."""
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(1, 60)] + [(0, [1.0, 0.0, 0.0], 0), (20, [1.0, 2.0, 3.0], 0)]
    rows += [(100, None, 1), (120, [0.0, 0.0, 0.0], 1), (140, [nan, 1.0, 1.0], 1), (160, [inf, 1.0, 1.0], 1)]
    rows += [(180, [None, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (200, [1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list int").repartition(3)
    found = defaultdict(list)
    for r in ann.self_neighbours(vectors, probes=1.0).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    assert [v for _, v in sorted(found[0])] == sorted([*range(1, 60), 20])[:20]
    assert set(found) == {0, 20, 40}
    assert ann.self_neighbours(vectors.limit(0)).collect() == []
    two = vectors.where("vec_id IN (0, 1)")
    assert [tuple(r) for r in ann.self_neighbours(two).collect()] == [(0, 1, 1, 1.0)]


def test_scan_in_strips(monkeypatch):
    monkeypatch.setattr(ann, "STRIP", 64)
    draw = np.random.default_rng(3)
    x, q = draw.normal(size=(500, 40)), draw.normal(size=(7, 40))
    rotation = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    who, what, score = ann.scan(q, np.arange(500), x, np.full(7, -1), rotation, 5, z=1e9)
    for i in range(7):
        expected = np.argsort(-(x @ q[i]))[:5]
        assert sorted(what[who == i]) == sorted(expected)


def test_repeated_rows_take_one_place(spark, monkeypatch):
    """Every row twice, and one id in a third of all rows, near everything: k ids are found, not k rows."""
    monkeypatch.setattr(ann, "SHARD", 200)
    draw = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(draw.normal(size=(240, 12)).tolist())] * 2
    rows += [(1000, (np.array(rows[20 * (i % 12)][1]) * 3 + draw.normal(size=12) / 9).tolist()) for i in range(240)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = vectors.where("vec_id % 20 = 0 AND vec_id < 1000")
    found = defaultdict(list)
    for r in ann.neighbours(vectors, queries, probes=1.0, z=1e9).collect():
        found[r.query_id].append((r["rank"], r.vec_id))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q in range(0, 240, 20):
        best = {}
        for i, score in zip(ids.tolist(), (x @ x[q]).tolist()):
            best[i] = max(score, best.get(i, score))
        del best[q]
        assert [v for _, v in sorted(found[q])] == sorted(best, key=lambda i: -best[i])[:20]


def test_scan_keeps_the_best_row_of_each_id():
    draw = np.random.default_rng(7)
    x, q = draw.normal(size=(300, 40)), draw.normal(size=(4, 40))
    ids = np.arange(300) % 30
    rotation = np.linalg.qr(draw.normal(size=(40, 40)))[0]
    who, what, _ = ann.scan(q, ids, x, np.full(4, -1), rotation, 20, z=1e9)
    for i in range(4):
        scores = x @ q[i]
        best = sorted(range(30), key=lambda v: -scores[v::30].max())[:20]
        assert sorted(ids[what[who == i]]) == sorted(best)


def shaped_vectors(shape):
    """1,200 vectors of 48 columns: close together, of very different lengths, or in a cone with a few far out."""
    draw = np.random.default_rng(8)
    x = draw.normal(size=(1200, 48))
    if shape == "tight":
        return draw.normal(size=48) + draw.normal(size=(12, 48))[np.arange(1200) % 12] / 4 + x / 40
    if shape == "lengths":
        return x * np.exp(draw.normal(size=(1200, 1)) * 3)
    if shape == "huge":
        return x * 1e200 * np.exp(draw.normal(size=(1200, 1)))
    x = x / 10 + np.eye(48)[0] * 4
    x[1::20] = 10 * (np.eye(48)[0] + 3 * np.eye(48)[1] + x[1::20] - x.mean(axis=0))
    return x


@pytest.mark.parametrize("shape", ["tight", "lengths", "huge", "cone"])
def test_nearest_of_rows_that_are_not_spread_evenly(spark, monkeypatch, shape):
    monkeypatch.setattr(ann, "REFERENCES", 100)
    x = shaped_vectors(shape)
    vectors = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(3)
    found = defaultdict(set)
    for r in ann.self_neighbours(vectors, probes=0.1 if shape == "cone" else ann.PROBES).collect():
        found[r.query_id].add(r.vec_id)
    hits, scaled = 0, x / np.abs(x).max()
    for q in range(0, 1200, 20):
        scores = scaled @ scaled[q]
        scores[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    # Products beyond the range of doubles are all as large: there, the smaller ids count.
    assert all(len(found[q]) == 20 for q in range(0, 1200, 20))
    assert shape == "huge" or hits / 1200 >= 0.99


# --- the pipeline ------------------------------------------------------------------------------


def test_stages(spark):
    docs = documents(spark).select("*", F.lit("x").alias("TEXT"))
    before = {r.doc_id: r.text for r in columns_of(docs).collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "pareto_mix", "genetic_packing"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    seen = {}
    for name, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, SMALL), name)
        seen[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == columns
    known = {r.doc_id for r in seen["language_id"]}
    assert known == {d for d, t in before.items() if t and re.search(r"[^\W\d_]", t)}
    assert {r.doc_id for r in seen["simhash_near_dedup"]} < known
    assert all(len(r.text) <= len(before[r.doc_id]) for r in seen["suffix_array_dedup"])
    assert max(Counter(r.doc_id for r in seen["pareto_mix"]).values()) <= 2
    assert {r.doc_id for r in seen["genetic_packing"]} == {r.doc_id for r in seen["pareto_mix"]}


def test_stages_of_odd_documents(spark):
    for rows in (odd_rows(), []):
        docs = odd_documents(spark, rows)
        for name, function in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(function(spark, docs, SMALL), name)
            docs.count()
