"""Toxicity scores by gradient-boosted trees over dense features, calibrated isotonically.

Features of a whole text: densities of insults from a short fixed list and from a lexicon learned from
labels (words and stems), how often they stand near a second-person word, capitals, punctuation,
repeated characters, and the rate of obfuscated words. Trees are grown on binned features.

Learning uses a bounded sample of labelled documents that are not held out: up to `per_class` of
either label, drawn by a hash of the id and split by another into three parts: for the lexicon, the
trees, the calibration. Labels of one document that disagree count as toxic; rows without an id, a
label or a text are not learned from. Scoring reads every character of every text; null
and empty texts are scored by their all-zero features. Without labels of both kinds every score is 0.
Every input row gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import held_out, parted, pick, stage

PER_CLASS = 6000
# Learned entries: at most so many, each in so many toxic documents and so many times likelier there.
LEXICON = 400
LEAST_DOCUMENTS = 4
LIFT = 12.0
STEMS = (4, 5)

# Insults and second-person words of the four languages.
INSULTS = (
    "idiot idiots moron stupid dumb fool loser trash scum worthless pathetic disgusting clown jerk bastard "
    "idioten dumm trottel arschloch abschaum dreck wertlos "
    "imbécile crétin connard débile minable ordure "
    "idiota estúpido imbécil basura escoria inútil"
).split()
SECOND_PERSON = (
    "you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros"
).split()
LETTERS = r"[^\W\d_]"
TERM = re.compile(rf"{LETTERS}+")
# Signs that stand for letters, before a letter; what is around them is looked at one by one.
SIGNS = re.compile(rf"[@$*!0-9|.]+(?={LETTERS})")
REST = re.compile(r"[\w@$*!|]*")
HEAD = re.compile(rf"[@$*!0-9|]*{LETTERS}+\Z")
LONGEST_HEAD = 30
PLAIN_LETTERS = str.maketrans(
    {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "|": "i", "0": "o", "5": "s", "$": "s", "7": "t", "*": None, ".": None}
)
UPPER, LOWER = (bytes(range(ord(a), ord(z) + 1)) for a, z in ("AZ", "az"))
# Characters within which a second-person word counts as near.
NEAR = 40

FEATURES = (
    "words insults learned weight strongest near_you obfuscated obfuscated_insults capitals exclamations questions "
    "symbols digits repeated you"
).split()


@dataclass
class Lexicon:
    """Insults and learned terms with weights; a key ending in * is a stem."""

    weights: dict[str, float]
    automaton: object = field(default=None, repr=False)

    def matches(self, text: str) -> Iterator[tuple[int, str]]:
        """Start and key of every entry in lower-cased `text` that begins, or is, a word."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for key in {*INSULTS, *self.weights}:
                stem = key.rstrip("*")
                keys = self.automaton.get(stem, ())
                self.automaton.add_word(stem, (*keys, key))
            self.automaton.make_automaton()
        for end, keys in self.automaton.iter(text):
            start = end - len(keys[0].rstrip("*")) + 1
            if start and text[start - 1].isalpha():
                continue
            inside = end + 1 < len(text) and text[end + 1].isalpha()
            for key in keys:
                if key.endswith("*") or not inside:
                    yield start, key

    def __getstate__(self):
        return {"weights": self.weights, "automaton": None}


def features(lexicon: Lexicon, text: str | None) -> list[float]:
    """The numbers of FEATURES; rates are per word or per character of the text."""
    text = text or ""
    data, lowered = text.encode(), text.lower()
    n_words = len(data.split())
    per_word, per_byte = 1000.0 / max(n_words, 1), 1000.0 / max(len(data), 1)
    insults = learned = near = 0
    weight = strongest = 0.0
    for start, key in lexicon.matches(lowered):
        if key in lexicon.weights:
            learned += 1
            weight += lexicon.weights[key]
            strongest = max(strongest, lexicon.weights[key])
        if key in INSULT_SET:
            insults += 1
        around = TERM.findall(lowered, max(0, start - NEAR), start + NEAR)
        near += not SECOND_SET.isdisjoint(around)
    hidden = obfuscated(lowered)
    bare = " ".join(word.translate(PLAIN_LETTERS) for word in hidden)
    hits = sum(1 for _ in lexicon.matches(bare)) if hidden else 0
    upper = len(data) - len(data.translate(None, UPPER))
    lower = len(data) - len(data.translate(None, LOWER))
    return [
        float(np.log1p(n_words)), insults * per_word, learned * per_word, weight * per_word, strongest,
        near * per_word, len(hidden) * per_word, hits * per_word, upper / max(upper + lower, 1),
        data.count(b"!") * per_byte, data.count(b"?") * per_byte,
        (len(data) - len(data.translate(None, b"#*$%&|<>@"))) * per_byte,
        (len(data) - len(data.translate(None, b"0123456789"))) * per_byte,
        repeated(data) * per_byte, float(np.log1p(insults + learned)),
    ]


def obfuscated(text: str) -> list[str]:
    """Words with signs or digits between letters."""
    words = []
    for signs in SIGNS.finditer(text):
        start, end = signs.span()
        head = HEAD.search(text[max(0, start - LONGEST_HEAD) : start])
        if head:
            words.append(head.group() + text[start : REST.match(text, end).end()])
    return words


def repeated(data: bytes) -> int:
    """Places where a letter stands the third time in a row."""
    a = np.frombuffer(data, np.uint8)
    return int(((a[2:] == a[1:-1]) & (a[1:-1] == a[:-2]) & (a[2:] >= 65)).sum())


INSULT_SET, SECOND_SET = frozenset(INSULTS), frozenset(SECOND_PERSON)


@dataclass
class Trees:
    """Boosted trees of DEPTH levels on binned features, with the calibration of their sum."""

    cuts: list[np.ndarray]
    splits: np.ndarray  # (tree, inner node, 2): feature and last bin that goes left
    leaves: np.ndarray  # (tree, leaf)
    raw: np.ndarray = field(default_factory=lambda: np.array([0.0]))
    calibrated: np.ndarray = field(default_factory=lambda: np.array([0.5]))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return _sums(binned(x, self.cuts), self.splits, self.leaves)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.sums(x), self.raw, self.calibrated)


BINS, DEPTH, TREES, RATE = 32, 3, 80, 0.15


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.int64)


def _sums(bins: np.ndarray, splits: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    total, rows = np.zeros(len(bins)), np.arange(len(bins))
    for split, leaf in zip(splits, leaves):
        node = np.zeros(len(bins), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (bins[rows, split[node, 0]] > split[node, 1])
        total += leaf[node - (2**DEPTH - 1)]
    return total


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Logistic loss, second-order gains, one histogram per level and feature."""
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS)[1:-1])) for i in range(x.shape[1])]
    # Rates that are zero almost everywhere need their first step at zero.
    cuts = [np.unique(np.concatenate([c, [0.0]])) for c in cuts]
    bins = binned(x, cuts)
    n_features, width = x.shape[1], max(len(c) for c in cuts) + 1
    splits = np.zeros((TREES, 2**DEPTH - 1, 2), np.int64)
    leaves = np.zeros((TREES, 2**DEPTH))
    margin = np.zeros(len(y))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            level = 2**depth
            at = node - (level - 1)
            for k in range(level):
                mine = np.flatnonzero(at == k)
                best = (1e-6, 0, width)
                for f in range(n_features):
                    gs = np.cumsum(np.bincount(bins[mine, f], g[mine], width))
                    hs = np.cumsum(np.bincount(bins[mine, f], h[mine], width))
                    gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (gain[b], f, b)
                splits[t, level - 1 + k] = best[1:]
            node = 2 * node + 1 + (bins[np.arange(len(y)), splits[t, node, 0]] > splits[t, node, 1])
        leaf = node - (2**DEPTH - 1)
        gs, hs = np.bincount(leaf, g, 2**DEPTH), np.bincount(leaf, h, 2**DEPTH)
        leaves[t] = -RATE * gs / (hs + 1)
        margin += leaves[t][leaf]
    return Trees(cuts, splits, leaves)


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the means of the blocks at their middles, to be joined by lines."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted labels, weighted raw
    for r, label, w in zip(raw[order], y[order], weight[order]):
        blocks.append([w, w * label, w * r])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    w, s, r = np.array(blocks).T
    return r / w, s / w


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.zeros(len(texts))
        return self.trees.probability(np.array([features(self.lexicon, text) for text in texts]))


def toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    marked = (
        pick(labels, doc_id="long", toxic="int")
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Model(Lexicon({}), None)
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40)) / float(1 << 40)
    chosen = marked.withColumn("draw", draw).where(F.col("draw") < share).orderBy("draw", "doc_id").limit(2 * per_class)
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4))
    # Broadcast: at most 2 * per_class rows.
    texts = pick(docs, doc_id="long", text="string").where(F.col("text").isNotNull())
    found = texts.join(F.broadcast(chosen.select("doc_id", "toxic", part.alias("part"))), "doc_id")
    # One text of each id, folded before it is shuffled, however many rows share the id.
    one = found.groupBy("doc_id", "toxic", "part").agg(F.max(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("most"))
    sample = stage(one.select("doc_id", "most.text", "toxic", "part"), "toxicity")

    lexicon = learned_lexicon(sample.where("part < 2"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            rows = [features(lexicon, text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), batch.column("part"), pa.array(rows, pa.list_(pa.float64()))],
                names=["toxic", "part", "x"],
            )

    # A few numbers for each of at most 2 * per_class documents.
    rows = (
        sample.where("part >= 2")
        .select("text", "toxic", "part")
        .mapInArrow(measure, "toxic int, part long, x array<double>")
        .orderBy("x", "toxic", "part")
        .collect()
    )
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    y, parts = np.array([r["toxic"] for r in rows], float), np.array([r["part"] for r in rows])
    # Each sampled document stands for as many as its class has.
    weight = np.where(y == 1, counts[1] / min(counts[1], per_class), counts[0] / min(counts[0], per_class))
    grow, calibrate = parts == 2, parts == 3
    if min((y[grow] == 1).sum(), (y[grow] == 0).sum(), (y[calibrate] == 1).sum(), (y[calibrate] == 0).sum()) < 3:
        grow = calibrate = parts >= 2  # too few documents for two parts
    if len(set(y[grow])) < 2:
        return Model(lexicon, None)
    trees = boost(x[grow], y[grow], weight[grow] / weight[grow].mean())
    trees.raw, trees.calibrated = isotonic(trees.sums(x[calibrate]), y[calibrate], weight[calibrate])
    return Model(lexicon, trees)


def learned_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that toxic documents hold far more often than others, with log ratios."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(TERM.findall(text.lower()))
                found = sorted(words | {w[:n] + "*" for n in STEMS for w in words if len(w) >= n})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["term", "toxic"]
                )

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    counts = sample.select("text", "toxic").mapInArrow(terms, "term string, toxic int").groupBy("term").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    )
    lift = (F.col("a") / toxic) / ((F.col("b") + 0.5) / clean)
    best = (
        counts.withColumn("lift", lift)
        .where((F.col("a") >= LEAST_DOCUMENTS) & (F.col("lift") >= LIFT))
        .orderBy(F.desc(F.col("a") * F.log("lift")), "term")
        .limit(LEXICON)
        .collect()
    )
    return Lexicon({r["term"]: float(np.log(r["lift"])) for r in best})


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted for every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            scores = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Fits on the labelled documents that are not held out and scores every row."""
    return score(docs, toxicity_model(docs, labels, per_class)).withColumn("held_out", held_out())
