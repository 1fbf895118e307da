"""Substring deduplication by seed and extend, over words.

Seeds are winnowed anchors of GRAM words; documents are joined on them (see repeats.py). Where the
stretches around a seed differ, all rows of the seed are extended together: to the right and to the left,
one word at a time, each step splits the rows that agreed so far by their next word. Two rows share a
window exactly if they still agree that far on both sides, so every window finds the earliest
row that has it without any pair of rows being written. What neighbouring windows cover joins into
maximal repeats of at least WINDOW words, and is cut.

Null and empty texts have no words. Every input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import parted
from cartlens.llm.repeats import Unit, covered, packed, unpacked, whole_rows, without_repeats

WINDOW = 20
GRAM = 8
SLICE = 8 << 20


def extend(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, key, text, place, contents in whole_rows(batches, SLICE):
            row, out_place = later_windows(unit, h, key, place, contents)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[row]), pa.array(text[row]), pa.array(out_place)], names=["key", "hash", "place"]
            )

    return run


def later_windows(unit: Unit, h, key, place, contents) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the windows of these regions that another one has at an earlier place."""
    version, off, n, lo = unpacked(place)
    rows = len(h)
    sizes = np.array([len(c) // 16 for c in contents], np.int64)
    words = np.frombuffer(b"".join(contents), np.dtype([("a", "<u8"), ("b", "<u8")]))
    _, word = np.unique(words, return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    alone = -1 - np.arange(rows)  # beyond a region's end no rows agree

    def at(places: np.ndarray) -> np.ndarray:
        inside = (places >= 0) & (places < sizes)
        return np.where(inside, word[np.where(inside, begin + places, 0)], alone)

    def split(classes: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.unique(classes << 32 | (by & 0xFFFFFFFF), return_inverse=True)[1]

    seed = np.unique(h, return_inverse=True)[1]
    for j in range(unit.gram):
        seed = split(seed, at(off + j))
    right, left = [seed], [seed]
    for step in range(1, unit.choices):
        right.append(split(right[-1], at(off + unit.gram + step - 1)))
        left.append(split(left[-1], at(off - step)))
    document = np.unique(key, return_inverse=True)[1]
    found_rows, found = [], []
    for reach in range(unit.choices):
        mine = np.flatnonzero((off >= reach) & (off - reach < n))
        same = left[reach][mine] << 32 | right[unit.choices - 1 - reach][mine]
        start = lo[mine] + off[mine] - reach
        when = document[mine] << 32 | start
        classes = np.unique(same, return_inverse=True)[1]
        first = np.full(len(mine), np.iinfo(np.int64).max)
        np.minimum.at(first, classes, when)
        later = when > first[classes]
        found_rows.append(mine[later])
        found.append(start[later])
    found_rows, found = np.concatenate(found_rows), np.concatenate(found)
    return found_rows, packed(version[found_rows], 0, 1, found)


def cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parted(batches):
        rows = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
            words = (text or "").encode().split()
            gone = covered(len(words), cuts)
            kept = [w for w, g in zip(words, gone.tolist()) if not g] if cuts else words
            rows.append((len(words), int(gone.sum()), b" ".join(kept).decode()))
        counts, removed, kept = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words (joined by spaces) of every row of `docs`."""
    unit = Unit(window, gram, words=True)
    return without_repeats(docs, unit, extend(unit), cut_words, "doc_id long, n_words long, n_removed long, kept string")


def digest(result: DataFrame) -> DataFrame:
    return result.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")
