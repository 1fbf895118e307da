"""Language identification with a small convolutional network over bytes.

Filters of several widths run over windows of bytes, each filter's largest response in a window goes
into a softmax over the languages, and a document's logits are the means over all its windows. The
input is one-hot bytes, so a filter is a table of 256 weights per place, and a response is a sum of
look-ups: training touches only the places that won the pooling, prediction looks up byte pairs.

Learning uses a bounded sample: up to `per_language` documents of each value of lang (of the
`max_languages` most frequent ones alone where that is given), and `windows` windows of each. Rows that are held out, without
text, lang or id are never learned from. Prediction covers every byte of every text.

Null texts and texts without a letter get `und` and score 0. So does every text when there is nothing
to learn from. Every input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import by_bytes, documents, held_out, parted, pick

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
# Windows whose responses are held at once.
ROWS = 512
# Places at which all filters fit into a window.
PLACES = WINDOW - max(WIDTHS) + 1
PER_LANGUAGE = 1500
WINDOWS = 2
EPOCHS = 6
# A text that no language gets this probability for, or OVER_CHANCE times an even share of it if that is less, is
# in none of the learned ones.
LEAST_SCORE = 0.3
OVER_CHANCE = 1.2
LETTER = regex.compile(r"\p{L}")
# Response of the padding behind a short text: never the largest in a window.
PAD = -1e3

SCHEMA = "doc_id long, lang_pred string, score double"


@dataclass
class Network:
    languages: list[str]
    tables: dict[int, np.ndarray]  # by width: (place, byte, filter)
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray] | None = None

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """One row per row of `windows` (WINDOW bytes each, zeros behind the text)."""
        first, second = self._pair_tables()
        wide = windows.astype(np.intp)
        pairs = wide[:, :-1] * 256 + wide[:, 1:]
        opening = first.take(pairs[:, :PLACES], axis=0)
        narrow = opening[:, :, :FILTERS].max(axis=1)
        rest = opening[:, :, FILTERS:]
        rest += second.take(pairs[:, 2:], axis=0)
        pooled = np.concatenate([narrow, rest.max(axis=1)], axis=1)
        return np.maximum(pooled + self.bias, 0) @ self.weights + self.offset

    def _pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by byte pairs, side by side for all widths: two look-ups a place in place of nine."""
        if self.pairs is None:
            t2, t3, t4 = (self.tables[w] for w in WIDTHS)
            both = [(t[k][:, None] + t[k + 1][None]).reshape(65536, -1) for t, k in ((t2, 0), (t3, 0), (t4, 0), (t4, 2))]
            third = np.repeat(t3[2], 256, axis=0)  # by the pair's first byte alone
            self.pairs = np.concatenate(both[:3], axis=1), np.concatenate([third, both[3]], axis=1)
        return self.pairs


def language_model(docs: DataFrame, per_language: int = PER_LANGUAGE, max_languages: int | None = None) -> Network | None:
    """A network fitted on the sample described above; None without any usable row."""
    rows = pick(docs, doc_id="long", text="string", lang="string").where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out()
    )
    # One row per language, or the max_languages most frequent ones.
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    found = (counted if max_languages is None else counted.limit(max_languages)).collect()
    if not found:
        return None
    languages = sorted(r["lang"] for r in found)
    # A document is in the sample if its hash falls below its language's share, so reruns agree.
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, per_language / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    length = F.length("text")
    cuts = [
        F.substring(
            "text", (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(length - WINDOW, F.lit(0)) + 1) + 1).cast("int"), F.lit(WINDOW)
        )
        for i in range(WINDOWS)
    ]
    sample = (
        rows.withColumn("draw", draw)
        .where((F.col("draw") < share[F.col("lang")]) & F.col("text").isNotNull())
        .select("lang", "doc_id", "draw", F.array(*cuts).alias("cuts"))
        # One row of each id and language, folded before it is shuffled, however many rows share the id.
        .groupBy("lang", "doc_id", "draw")
        .agg(F.max("cuts").alias("cuts"))
        .orderBy("draw", "doc_id", "lang", "cuts")
        .limit(per_language * len(languages))
        .collect()
    )
    pairs = [(r["lang"], cut) for r in sample for cut in r["cuts"] if LETTER.search(cut)]
    if not pairs:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.stack([window_of(cut.encode()) for _, cut in pairs])
    return fit(windows, np.array([number[lang] for lang, _ in pairs]), languages)


def window_of(data: bytes) -> np.ndarray:
    data = data.lower()[:WINDOW]
    return np.frombuffer(data + bytes(WINDOW - len(data)), np.uint8)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Softmax regression on pooled responses, all layers trained by Adam on small batches."""
    draw = np.random.default_rng(seed)
    width_of = np.repeat(WIDTHS, FILTERS)
    tables = {w: draw.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    params = {
        **{f"t{w}": t for w, t in tables.items()},
        "bias": np.zeros(len(width_of), np.float32),
        "weights": draw.normal(0, 0.2, (len(width_of), len(languages))).astype(np.float32),
        "offset": np.zeros(len(languages), np.float32),
    }
    moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in params.items()}
    for w in WIDTHS:
        params[f"t{w}"][:, 0] = PAD
    steps, batch = 0, 64
    for epoch in range(epochs):
        order = draw.permutation(len(windows))
        rate = 0.02 * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            x, n = windows[rows], len(rows)
            pooled, won = [], []
            for w in WIDTHS:
                t, m = params[f"t{w}"], PLACES
                response = t[0][x[:, :m]]
                for k in range(1, w):
                    response = response + t[k][x[:, k : k + m]]
                best = response.argmax(axis=1)
                won.append(best)
                pooled.append(np.take_along_axis(response, best[:, None, :], 1)[:, 0])
            z = np.concatenate(pooled, axis=1) + params["bias"]
            h = np.maximum(z, 0)
            logits = h @ params["weights"] + params["offset"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), labels[rows]] -= 1
            p /= n
            dz = (p @ params["weights"].T) * (z > 0)
            grads = {"weights": h.T @ p, "offset": p.sum(axis=0), "bias": dz.sum(axis=0)}
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(params[f"t{w}"])
                d = dz[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[k], (np.take_along_axis(x, won[i] + k, 1), np.arange(FILTERS)[None]), d)
                g[:, 0] = 0
                grads[f"t{w}"] = g
            steps += 1
            for name, g in grads.items():
                first, second = moments[name]
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                step = (first / (1 - 0.9**steps)) / (np.sqrt(second / (1 - 0.99**steps)) + 1e-6)
                params[name] -= (rate * step).astype(np.float32)
    return Network(languages, {w: params[f"t{w}"] for w in WIDTHS}, params["bias"], params["weights"], params["offset"])


def predict(network: Network | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and its probability for each text."""
    languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, text in enumerate(texts) if network and text and LETTER.search(text)]
    data = [texts[i].encode().lower() for i in known]
    for a, b in by_bytes([len(d) for d in data], 1 << 20):
        part = data[a:b]
        counts = np.array([-(-len(d) // WINDOW) for d in part])
        total = np.zeros((len(part), len(network.languages)))
        # Each text starts a window of its own; zeros fill its last one.
        flat = np.frombuffer(b"".join(d + bytes(-len(d) % WINDOW) for d in part), np.uint8).reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(part)), counts)
        for at in range(0, len(flat), ROWS):
            rows = flat[at : at + ROWS]
            np.add.at(total, owner[at : at + ROWS], network.logits(rows) * (rows != 0).sum(axis=1, keepdims=True))
        mean = total / np.array([max(1, len(d)) for d in part])[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for i, row in zip(known[a:b], p):
            languages[i], scores[i] = network.languages[int(row.argmax())], float(row.max())
    return languages, scores


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred and score for every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            languages, scores = predict(network, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(run, SCHEMA)


def least_score(network: Network | None) -> float:
    """The least probability for a text to be in a learned language: the more there are, the lower."""
    return min(LEAST_SCORE, OVER_CHANCE / len(network.languages)) if network else 0.0


def with_known_language(docs: DataFrame, network: Network | None, least: float | None = None) -> DataFrame:
    """The documents whose text is in a learned language (`least_score`); all that have a letter if there is no network."""
    least = least_score(network) if least is None else least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            texts = batch.column("text").to_pylist()
            _, scores = predict(network, texts)
            known = [bool(text and LETTER.search(text)) and score >= least for text, score in zip(texts, scores)]
            yield batch.filter(pa.array(known, pa.bool_()))

    docs = documents(docs)
    return docs.mapInArrow(run, docs.schema)


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fits on the rows of `docs` that are not held out and predicts every row."""
    return identify(docs, language_model(docs, per_language)).withColumn("held_out", held_out())
