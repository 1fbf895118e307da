"""Phrase collocations per language, counted over a prefix-free parse.

1. Parsing. A text is a sequence of words with a blank or a break (punctuation, line end) after each. A window of
   TRIGGER words whose hash is divisible by PERIOD ends a chunk and begins the next one, so neighbouring chunks
   overlap by that window and what is a chunk depends on nearby content alone: copies give the same chunks.
2. Dictionary. Equal chunks of a language are one row with the number of times they stand in the corpus.
3. Counting. N-grams are counted inside the distinct chunks, times that number. An n-gram belongs to the chunk in
   which it starts before the closing window; those that start in the window are the next chunk's. As no phrase
   is longer than TRIGGER + 1 words, each lies whole in its chunk and is counted once.

Counting takes two passes over the dictionary. The first counts words and pairs by a hash of 40 bits and keeps
those that reach the least count as a bit map of BITS bits, which is what the second is sent (16 MB at any size).
The second counts by their text the n-grams whose words and pairs all stand in the map: those that reach the least
count and some others, which their exact counts drop. A full map costs time and no result.

Null and empty texts have no words. A null language counts as `und`. Every row counts, equal rows as often as
they stand. Texts of any length are parsed whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import parted, pick, stage
from cartlens.llm.repeats import BASES, TABLES, Sums, mixed

LONGEST = 4
TRIGGER = LONGEST - 1
PERIOD = 16
LEAST = 30
FIRST = 2000
# Of 100: the share of a phrase's occurrences that lie in a longer phrase which then stands for it.
CONTAINED = 80
SCALE = 2_000_000
BITS = 1 << 27
BITMAP_BITS = 32_768
HASH = np.uint64((1 << 40) - 1)
# Phrases of a language are ranked in so many parts first.
PARTS = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK, BREAK = 32, 10
KIND = np.zeros(256, np.uint8)
KIND[[32, 9]] = BLANK
KIND[[*b".,;:!?", 10, 11, 12, 13]] = BREAK

CHUNK = "lang string, last boolean, own int, text binary"
GRAM = "lang string, words int, phrase binary, times long"


def spelled(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, lower-cased, each with one blank or break behind it; where each word starts and
    ends in that, and which text it is of."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    kind = KIND[data]
    word = np.concatenate([[False], kind == 0])
    starts = np.flatnonzero(word[1:] & ~word[:-1])
    ends = np.flatnonzero(~word[1:] & word[:-1])
    breaks = np.cumsum(np.concatenate([[0], kind == BREAK]))
    after = np.append(starts[1:], len(data))
    behind = np.where(breaks[after] > breaks[ends], BREAK, BLANK).astype(np.uint8)
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    upto = np.cumsum(ends - starts + 1)
    out = np.empty(int(upto[-1]) if len(upto) else 0, np.uint8)
    last = np.zeros(len(out), bool)
    last[upto - 1] = True
    out[last] = behind
    out[~last] = data[word[1:]]
    return out, upto - (ends - starts + 1), upto - 1, owner


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """CHUNK rows of lang, text rows."""
    for batch in parted(batches):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        data, starts, ends, owner = spelled(texts)
        n = len(starts)
        if not n:
            continue
        opens = np.ones(n, bool)
        opens[1:] = owner[1:] != owner[:-1]
        if n >= TRIGGER:
            whole = owner[TRIGGER - 1 :] == owner[: n - TRIGGER + 1]
            hashes = mixed(Sums(TABLES[0][data], BASES[0]).of(starts[: n - TRIGGER + 1], ends[TRIGGER - 1 :]))
            opens[: n - TRIGGER + 1] |= whole & (hashes % np.uint64(PERIOD) == 0)
        first = np.flatnonzero(opens)
        following = np.append(first[1:], n)
        last = np.append(owner[first[1:]] != owner[first[:-1]], True)
        end = np.where(last, following - 1, following + TRIGGER - 1)
        held = data.tobytes()
        chunks = [held[a:b] for a, b in zip(starts[first].tolist(), ends[end].tolist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang").take(pa.array(owner[first])), pa.array(last), pa.array((following - first).astype(np.int32)), pa.array(chunks, pa.binary())],
            names=["lang", "last", "own", "text"],
        )


def dictionary(docs: DataFrame) -> DataFrame:
    """Distinct chunks: lang, last (of its text), own (words that are counted here), text, times, written down."""
    rows = pick(docs, lang="string", text="string").withColumn("lang", F.coalesce("lang", F.lit("und")))
    chunks = rows.mapInArrow(parse, CHUNK).groupBy("lang", "last", "text")
    return stage(chunks.agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("times")).withColumn("seed", F.xxhash64("lang")), "chunks")


class Chunks:
    """The words of a batch of the dictionary and the n-grams that start at each."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        texts = batch.column("text").to_pylist()
        self.bytes = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.flatnonzero((self.data == BLANK) | (self.data == BREAK))
        self.starts = np.append(0, self.ends[:-1] + 1) if len(self.ends) else self.ends
        bounds = np.searchsorted(self.starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        self.chunk = np.repeat(np.arange(len(texts)), np.diff(bounds))
        self.own = np.arange(len(self.starts)) - bounds[self.chunk] < batch.column("own").to_numpy()[self.chunk]
        self.times = batch.column("times").to_numpy()
        self.seeds = batch.column("seed").to_numpy().view(np.uint64)
        self.joined = np.append(self.data[self.ends] == BLANK, False)
        self.sums = [Sums(TABLES[i][self.data], BASES[i]) for i in (0, 1)]

    def of(self, at: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        """Hashes of the n-grams that start at these words, apart for each language."""
        return mixed(self.sums[which].of(self.starts[at], self.ends[at + n - 1]) + self.seeds[self.chunk[at]])

    def pairs(self) -> np.ndarray:
        """True for words that a word of the same piece follows."""
        return self.joined[: len(self.starts)] & (np.arange(len(self.starts)) + 1 < len(self.starts))


def common_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words and pairs and how often they stand in the corpus."""
    for batch in parted(batches, 4 << 20):
        chunks = Chunks(batch)
        words, pairs = np.flatnonzero(chunks.own), np.flatnonzero(chunks.own & chunks.pairs())
        keys = np.concatenate([chunks.of(words, 1), chunks.of(pairs, 2)]) & HASH
        times = chunks.times[chunks.chunk[np.concatenate([words, pairs])]]
        order = np.argsort(keys)
        keys = keys[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        if len(new):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[new].view(np.int64)), pa.array(np.add.reduceat(times[order], new))], names=["h", "times"]
            )


def common_map(chunks: DataFrame, least: int) -> np.ndarray:
    """The bit map of the hashes of words and pairs that reach `least`; BITS bits at most reach the driver."""
    counted = chunks.mapInArrow(common_hashes, "h long, times long").groupBy("h").agg(F.sum("times").alias("times"))
    bit = F.col("h").bitwiseAND(BITS - 1)
    common = counted.where(F.col("times") >= least).select((bit / BITMAP_BITS).cast("int").alias("page"), (bit % BITMAP_BITS).alias("bit"))
    pages = common.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for row in pages.collect():
        out[row.page * BITMAP_BITS // 8 : (row.page + 1) * BITMAP_BITS // 8] = np.frombuffer(bytes(row.bits), np.uint8)
    return out


def counted_grams(common) -> Callable:
    """GRAM rows: the n-grams of dictionary rows whose words and pairs stand in the broadcast map `common`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value

        def stands(keys: np.ndarray) -> np.ndarray:
            bit = keys & np.uint64(BITS - 1)
            return (known[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        for batch in parted(batches, 4 << 20):
            chunks = Chunks(batch)
            n = len(chunks.starts)
            pair = np.zeros(n + LONGEST, bool)
            pairs = np.flatnonzero(chunks.pairs())
            pair[pairs] = stands(chunks.of(pairs, 2))
            begins = np.flatnonzero(chunks.own)
            begins = begins[stands(chunks.of(begins, 1))]
            for words in range(1, LONGEST + 1):
                if words > 1:
                    begins = begins[pair[begins + words - 2]]
                if not len(begins):
                    break
                first, second = chunks.of(begins, words), chunks.of(begins, words, 1)
                order = np.argsort(first)
                first, second, begins_sorted = first[order], second[order], begins[order]
                new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
                at = begins_sorted[new]
                phrases = [chunks.bytes[a:b] for a, b in zip(chunks.starts[at].tolist(), chunks.ends[at + words - 1].tolist())]
                times = np.add.reduceat(chunks.times[chunks.chunk[begins_sorted]], new)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").take(pa.array(chunks.chunk[at])), pa.array(np.full(len(at), words, np.int32)), pa.array(phrases, pa.binary()), pa.array(times)],
                    names=["lang", "words", "phrase", "times"],
                )

    return run


def frequent_phrases(chunks: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, times of all phrases of 1 to LONGEST words that stand `least` times, written down."""
    common = chunks.sparkSession.sparkContext.broadcast(common_map(chunks, least))
    grams = chunks.mapInArrow(counted_grams(common), GRAM).groupBy("lang", "words", "phrase")
    counted = grams.agg(F.sum("times").alias("times")).where(F.col("times") >= least)
    return stage(counted.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def scored_phrases(phrases: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of all candidates: the cut with the lowest score counts."""
    candidates = phrases.where("words > 1").withColumnRenamed("times", "a")
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "*", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - words)").alias("right")
    )
    left = phrases.select("lang", F.col("phrase").alias("left"), F.col("times").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("right"), F.col("times").alias("r"))
    both = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    wide = "cast({} as decimal(20,0))".format
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * {wide('a')}) div ({wide('l')} + {wide('r')})")
    lowest = both.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def contained_phrases(phrases: DataFrame) -> DataFrame:
    """lang, phrase and the most times that a longer candidate with this phrase in it stands (`within`)."""
    longer = phrases.where("words > 2").select("lang", "times", "words", F.split("phrase", " ").alias("parts"))
    inner = longer.select(
        "lang", "times",
        F.explode(F.expr("""
            flatten(transform(sequence(2, words - 1), n ->
                transform(sequence(1, words - n + 1), i -> array_join(slice(parts, i, n), ' '))))""")).alias("phrase"),
    )
    return inner.groupBy("lang", "phrase").agg(F.max("times").alias("within"))


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `first` phrases that stand at least `least` times."""
    chunks = dictionary(docs)
    phrases = frequent_phrases(chunks, least)
    kept = scored_phrases(phrases).join(contained_phrases(phrases), ["lang", "phrase"], "left")
    wide = F.col("within").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * CONTAINED
    kept = kept.where(~F.coalesce(wide, F.lit(False)))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    # A language's best are among the best of its parts, so one task sees PARTS * first rows at most.
    parts = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
    parts = parts.where(F.col("rank") <= first)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
