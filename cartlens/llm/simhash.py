"""Near-duplicates by SimHash: fingerprints, a covering-code join of close ones, components.

A fingerprint's bits are the majority votes of the XXH64 hashes of its text's word shingles. Two
fingerprints are linked if they differ in at most `THRESHOLD` bits.

Links are found through anchor points. The anchors are the words of a covering code on 46 of the 64
bits: two blocks of the perfect binary Golay code, so every fingerprint lies within RADIUS = 3 + 3
bits of an anchor. A fingerprint goes to its own nearest anchor and to every anchor within
RADIUS + THRESHOLD bits; if y is linked to x, y is that close to the nearest anchor of x, so the two
meet there. Each anchor compares those it is the nearest of with all it was sent.

An anchor that is sent more than HOT fingerprints is split. Two bits cannot touch all three thirds of a
fingerprint, so linked ones agree on one: the rows of such an anchor meet by (third, its bits) instead, and
the anchor's own are dealt into blocks of about OWN, of which each is held in memory while the others' rows
stream past. So no task holds a whole hot anchor, and no pair is lost.

Equal fingerprints are one class from the start. Anchors report spanning links of what they found, not
all pairs, and classes, links and components stay tables.

A null or empty text has fingerprint 0 and is linked like any other. A null id joins a component but
only names one that has no other id. Every input row gives one row; repeated rows are equal texts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import by_bytes, documents, parted, pick, stage
from cartlens.llm.graph import components

SHINGLE = 3
SEED = 42
THRESHOLD = 2
BLOCK = 23
# Fixed value: generator polynomial of the binary Golay code.
GOLAY = 0b101011100011
RADIUS = 6
# From this many fingerprints at one anchor, only those that agree on a third of the bits are compared.
LARGE = 2000
PAIRS = 1 << 21
# Rows sent to an anchor above which it is split, and its own fingerprints in a block of a split one.
HOT = 1 << 16
OWN = 1 << 14
THIRDS = ((0, 21), (21, 21), (42, 22))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long) of every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            prints = simhash(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"]
            )

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, fingerprint long")


def simhash(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    data = [(text or "").encode().lower() for text in texts]  # bytes: lowers A-Z alone
    prints = np.zeros(len(data), np.uint64)
    digest = xxhash.xxh64_intdigest
    for start, end in by_bytes([len(d) for d in data], 1 << 20):
        counts, hashes = [], []
        for text in data[start:end]:
            words = text.split()  # white space of bytes: the six ASCII characters
            n = max(len(words) - shingle + 1, min(len(words), 1))
            counts.append(n)
            if n:
                plain = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                begins = [0, *(ends[: n - 1] + 1).tolist()]
                hashes += [digest(plain[a:b], SEED) for a, b in zip(begins, ends[-n:].tolist())]
        counts = np.array(counts)
        present = np.flatnonzero(counts)
        if not len(present):
            continue
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        firsts = np.concatenate([[0], np.cumsum(counts[present])[:-1]])
        votes = np.add.reduceat(bits, firsts, axis=0, dtype=np.int64)
        majority = np.packbits(2 * votes > counts[present][:, None], axis=1, bitorder="little")
        prints[start + present] = majority.view(np.uint64)[:, 0]
    return prints


@dataclass
class Code:
    """The Golay code by syndromes: for each, the correction and all words in order of distance."""

    leader: np.ndarray  # (2048,) error pattern that leads to the nearest word
    order: np.ndarray  # (2048, n) words by their distance from that error pattern
    within: np.ndarray  # (2048, 10) how many lie within distance -1, 0, 1, ...

    @staticmethod
    @functools.lru_cache(maxsize=1)
    def golay() -> Code:
        words = np.array([m << 11 | _remainder(m << 11) for m in range(4096)], np.uint32)
        leader = np.zeros(2048, np.uint32)
        errors = [0, *(1 << i for i in range(BLOCK))]
        errors += [1 << i | 1 << j for i in range(BLOCK) for j in range(i)]
        errors += [1 << i | 1 << j | 1 << k for i in range(BLOCK) for j in range(i) for k in range(j)]
        for error in errors:
            leader[_remainder(error)] = error
        furthest = RADIUS + THRESHOLD
        distance = np.bitwise_count(leader[:, None] ^ words[None])
        within = np.stack([np.zeros(2048, np.int64), *((distance <= d).sum(axis=1) for d in range(furthest + 1))], axis=1)
        order = np.argsort(distance, axis=1, kind="stable")[:, : within.max()]
        return Code(leader, words[order], within)

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        """Remainders of many words at once: the code is linear."""
        out = np.zeros(len(words), np.uint32)
        for i in range(BLOCK):
            out ^= np.where(words >> np.uint32(i) & np.uint32(1), np.uint32(_remainder(1 << i)), np.uint32(0))
        return out


def _remainder(word: int) -> int:
    for i in range(BLOCK - 1, 10, -1):
        if word >> i & 1:
            word ^= GOLAY << (i - 11)
    return word


def anchors_of(prints: np.ndarray, reach: int = RADIUS + THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors within `reach` of each fingerprint: (anchor, place of the fingerprint, is it the nearest)."""
    code, mask = Code.golay(), np.uint64((1 << BLOCK) - 1)
    blocks = [(prints >> np.uint64(shift) & mask).astype(np.uint32) for shift in (0, BLOCK)]
    s1, s2 = map(code.syndromes, blocks)
    near1, near2 = blocks[0] ^ code.leader[s1], blocks[1] ^ code.leader[s2]
    found = []
    for d in range(reach + 1):  # bits spent in the first block
        first, n1, n2 = code.within[s1, d], code.within[s1, d + 1] - code.within[s1, d], code.within[s2, reach - d + 1]
        n = n1 * n2
        who = np.repeat(np.arange(len(prints)), n)
        place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        a = near1[who] ^ code.order[s1[who], first[who] + place // n2[who]]
        b = near2[who] ^ code.order[s2[who], place % n2[who]]
        found.append((a.astype(np.int64) | b.astype(np.int64) << BLOCK, who, (a == near1[who]) & (b == near2[who])))
    return tuple(np.concatenate(x) for x in zip(*found))


def links(classes: DataFrame) -> DataFrame:
    """Spanning links (a, b) of the fingerprints of `classes` that differ in at most THRESHOLD bits."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fingerprint").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(prints), 1000):
                part = prints[at : at + 1000]
                anchor, who, nearest = anchors_of(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(part[who].view(np.int64)), pa.array(nearest)],
                    names=["anchor", "fingerprint", "nearest"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, prints, nearest in whole_groups(batches):
            a, b = spanning(*close_pairs(anchor, prints, nearest))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

    sent = classes.select("fingerprint").mapInArrow(spread, "anchor long, fingerprint long, nearest boolean")
    met = split(sent).repartition("anchor").sortWithinPartitions("anchor", F.desc("nearest"))
    return met.mapInArrow(compare, "a long, b long")


def split(sent: DataFrame, hot: int = HOT, own: int = OWN) -> DataFrame:
    """`sent` (anchor, fingerprint, nearest) with the anchors that more than `hot` rows were sent to split into
    meeting places of their own, named by hash: should two have one name, they only compare more."""
    counts = sent.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if("nearest").alias("own"))
    # At most 1 / hot of the rows; the planner joins it by its written size.
    wide = stage(counts.where(F.col("n") > hot).select("anchor", "own"), "hot-anchors")
    blocks = F.greatest(F.ceil(F.col("own") / own), F.lit(1))
    mine = F.pmod(F.xxhash64("fingerprint"), blocks)
    thirds = F.array(*[
        F.struct(
            F.lit(shift).alias("third"),
            F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << width) - 1)).alias("bits"),
        )
        for shift, width in THIRDS
    ])

    def place(third: Column, block: Column) -> Column:
        return F.struct(
            F.xxhash64("anchor", third["third"], third["bits"], block).alias("anchor"),
            (F.col("nearest") & (block == mine)).alias("nearest"),
        )

    every = F.sequence(F.lit(0).cast("long"), blocks - 1)
    several = F.flatten(F.transform(thirds, lambda third: F.transform(every, lambda block: place(third, block))))
    places = F.when(F.col("own").isNull(), F.array(F.struct("anchor", "nearest"))).otherwise(several)
    met = sent.join(wide, "anchor", "left").select("fingerprint", F.inline(places))
    return met.select("anchor", "fingerprint", "nearest")


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted batches, joined and cut so that no anchor is split between two; of an anchor with more
    than `rows`, its own, which stand first, are repeated with each part of the others."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        if sum(len(x[0]) for x in held) < rows:
            continue
        anchor, prints, nearest = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            yield anchor[:cut], prints[:cut].view(np.uint64), nearest[:cut]
        held = [[anchor[cut:], prints[cut:], nearest[cut:]]]
        if not cut and not nearest.all():
            yield anchor, prints.view(np.uint64), nearest
            own = int(nearest.sum())
            held = [[anchor[:own], prints[:own], nearest[:own]]]
    if held:
        anchor, prints, nearest = (np.concatenate(x) for x in zip(*held))
        yield anchor, prints.view(np.uint64), nearest


def close_pairs(anchor: np.ndarray, prints: np.ndarray, nearest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the same anchor within THRESHOLD bits, one of them the anchor's own."""
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(anchor)))
    left, right = _within(prints, nearest, starts[sizes < LARGE], sizes[sizes < LARGE])
    for start, size in zip(starts[sizes >= LARGE], sizes[sizes >= LARGE]):
        # Two bits cannot touch all three parts of a fingerprint, so linked ones agree on a part.
        rows = slice(start, start + size)
        for shift, width in THIRDS:
            part = prints[rows] >> np.uint64(shift) & np.uint64((1 << width) - 1)
            order = start + np.argsort(part, kind="stable")
            part = np.sort(part)
            firsts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            a, b = _within(prints[order], nearest[order], firsts, np.diff(np.append(firsts, size)))
            left, right = np.concatenate([left, a]), np.concatenate([right, b])
    return left, right


def _within(prints, nearest, starts, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs inside runs of rows, compared in blocks of about PAIRS."""
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return prints[:0], prints[:0]
    rows = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes)])
    run = np.repeat(np.arange(len(starts)), sizes)
    own = nearest[rows]
    asks, of = rows[own], run[own]
    out = []
    block = np.cumsum(sizes[of]) // PAIRS
    for k in np.unique(block):
        q, r = asks[block == k], of[block == k]
        n = sizes[r]
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - starts[r], n)
        x, y = prints[np.repeat(q, n)], prints[other]
        close = (np.bitwise_count(x ^ y) <= THRESHOLD) & (x != y)
        out.append((x[close], y[close]))
    return (np.concatenate(x) for x in zip(*out)) if out else (prints[:0], prints[:0])


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest of its component among the pairs: fewer than nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def classes(printed: DataFrame) -> DataFrame:
    """fingerprint, root (the smallest fingerprint of its component) and component_id of every fingerprint."""
    found = stage(printed.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "classes")
    roots = components(links(found))
    rooted = found.join(roots, found["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = stage(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(named, "root").select("fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row of `docs` (doc_id, text)."""
    printed = stage(fingerprints(docs), "fingerprints")
    return printed.join(classes(printed).drop("root"), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the smallest id, null last; of equal ids, one."""
    docs = documents(docs)
    printed = stage(fingerprints(docs), "fingerprints")
    rows = printed.join(classes(printed), "fingerprint")
    chosen = rows.groupBy("root").agg(
        F.min_by(F.struct("doc_id", "fingerprint"), F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint")).alias("chosen")
    )
    chosen = chosen.select(F.col("chosen.doc_id").alias("d"), F.col("chosen.fingerprint").alias("f"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            prints = pa.array(simhash(batch.column("text").to_pylist()).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], names=[*batch.schema.names, "fingerprint"])

    schema = T.StructType([*docs.schema, T.StructField("fingerprint", T.LongType())])
    kept = docs.mapInArrow(add, schema).join(
        chosen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fingerprint") == F.col("f")), "left_semi"
    )
    alike = Window.partitionBy("doc_id", "fingerprint").orderBy(F.xxhash64("text"))
    return kept.withColumn("row", F.row_number().over(alike)).where("row = 1").select(*docs.columns)
