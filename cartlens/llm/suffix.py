"""Deduplication of repeated byte strings by suffix arrays of shards.

Documents meet on winnowed anchors (see repeats.py). The stretches around anchors that differ go,
by anchor, into shards of a few megabytes; two equal strings always fall into the same shard. A
shard's suffixes are sorted by induction: they are classified as larger or smaller than the next one,
leftmost-smaller substrings are sorted by a first induction and named, the string of names is sorted
by the same question asked again for ever longer pieces (names of pairs, of pairs of pairs), and a
second induction sorts all suffixes in linear time. Common prefixes are computed in text order: only
where the preceding bytes differ are bytes compared, everywhere else the value is one less than before.
Suffixes that share a window stand together; all but the earliest of them are repeats.

Induction goes bucket by bucket: what a bucket's suffixes induce is placed with one array operation.

Bytes of a text that a repeated window covers are removed; overlaps count once. Null and empty
texts have no bytes. Every input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import parted
from cartlens.llm.repeats import Unit, covered, packed, unpacked, whole_rows, without_repeats

WINDOW = 100
GRAM = 32
SHARD = 1 << 20


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the sorted suffixes of whole numbers; the last one is the only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = classify(text)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = smaller[1:] & ~smaller[:-1]
    lms = np.flatnonzero(is_lms)
    first = induce(text, smaller, lms)
    substrings = first[is_lms[first]]
    names = np.zeros(n, np.int64)
    names[substrings] = name(text, substrings, lms)
    rank = sorted_names(names[lms])
    by_rank = np.empty(len(lms), np.int64)
    by_rank[rank] = lms
    return induce(text, smaller, by_rank)


def classify(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last is."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    # In a run of equal characters the first change after it decides.
    change = np.where(step != 0, np.arange(n - 1), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = np.append(step, 1)[change] > 0
    return smaller


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, sorted from the order of the leftmost smaller ones."""
    n, width = len(text), int(text.max()) + 1
    counts = np.bincount(text, minlength=width)
    ends = np.cumsum(counts)
    begins = ends - counts
    out = np.full(n, -1, np.int64)
    of = np.bincount(text[lms], minlength=width)
    order = np.argsort(text[lms], kind="stable")
    seeds = ends - of
    bucket = text[lms][order]
    out[seeds[bucket] + np.arange(len(lms)) - (np.cumsum(of) - of)[bucket]] = lms[order]
    head, tail = begins.copy(), ends.copy()

    def push(block: np.ndarray, larger: bool) -> None:
        before = block[block > 0] - 1
        before = before[smaller[before] != larger]
        if not len(before):
            return
        bucket = text[before]
        order = np.argsort(bucket, kind="stable")
        before, bucket = before[order], bucket[order]
        added = np.bincount(bucket, minlength=width)
        place = np.arange(len(before)) - (np.cumsum(added) - added)[bucket]
        if larger:
            out[head[bucket] + place] = before
            head[:] += added
        else:
            out[tail[bucket] - 1 - place] = before
            tail[:] -= added

    used = np.flatnonzero(counts)
    for c in used:
        at = begins[c]
        while at < head[c]:  # what a bucket induces into itself follows in the next turn
            at, start = head[c], at
            push(out[start:at].copy(), True)
        if of[c]:
            push(out[seeds[c] : ends[c]].copy(), True)
    tail[text[-1]] -= 1
    out[tail[text[-1]]] = n - 1
    for c in used[::-1]:
        at = ends[c]
        while at > tail[c]:
            at, end = tail[c], at
            push(out[at:end][::-1].copy(), False)
        push(out[begins[c] : head[c]][::-1].copy(), False)
    return out


def name(text: np.ndarray, substrings: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Numbers of sorted leftmost-smaller substrings, equal ones alike."""
    n = len(text)
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms)
    a, b = substrings[:-1], substrings[1:]
    equal = length[a] == length[b]
    open_ = np.flatnonzero(equal)
    step = 0
    while len(open_):
        same = text[a[open_] + step] == text[b[open_] + step]
        equal[open_[~same]] = False
        open_ = open_[same]
        step += 1
        open_ = open_[length[a[open_]] >= step]
    return np.concatenate([[0], np.cumsum(~equal)])


def sorted_names(names: np.ndarray) -> np.ndarray:
    """Rank of each suffix of a string of names, by names of pieces that double in length."""
    rank, step = names, 1
    while True:
        distinct = int(rank.max()) + 1
        if distinct == len(rank):
            return rank
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (distinct + 1) + after, return_inverse=True)[1]
        step *= 2


def common_prefixes(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Length shared with the suffix sorted before it, for every suffix in text order."""
    n = len(text)
    previous = np.full(n, -1, np.int64)
    previous[suffixes[1:]] = suffixes[:-1]
    known = previous >= 0
    # Reducible: the preceding characters are equal, so the value is one less than that of the place before.
    reducible = np.zeros(n, bool)
    inner = np.flatnonzero(known[1:] & (previous[1:] > 0)) + 1
    reducible[inner] = text[inner - 1] == text[previous[inner] - 1]
    places = np.flatnonzero(known & ~reducible)
    padded = np.append(text.astype(np.uint64), np.zeros(4, np.uint64))
    four = padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    length = np.zeros(n, np.int64)
    open_, step = places, 0
    while len(open_):  # four characters at a time while they agree
        far = np.minimum(n, np.maximum(open_, previous[open_]) + step)
        same = (far < n) & (four[np.minimum(open_ + step, n)] == four[np.minimum(previous[open_] + step, n)])
        length[open_[same]] += 4
        open_, step = open_[same], step + 4
    for _ in range(3):
        a, b = places + length[places], previous[places] + length[places]
        inside = np.maximum(a, b) < n
        same = inside & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
        length[places[same]] += 1
        places = places[same]
    fixed = np.where(known & ~reducible | ~known, length + np.arange(n), -1)
    return np.maximum.accumulate(fixed) - np.arange(n)


def compare(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, text, place, contents in whole_rows(batches, SHARD):
            row, out_place = later_windows(unit, key, place, contents)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[row]), pa.array(text[row]), pa.array(out_place)], names=["key", "hash", "place"]
            )

    return run


def later_windows(unit: Unit, key, place, contents) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places of the stretches of windows of a shard that start earlier somewhere else in it."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    version, _, n, lo = unpacked(place)
    sizes = np.array([len(c) for c in contents], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    # Bytes from 2 up, 1 behind every region, 0 at the end.
    data = np.frombuffer(b"\0".join(contents) + b"\0\0", np.uint8).astype(np.uint16) + 2
    data[begins + sizes] = 1
    data[-1] = 0
    suffixes = suffix_array(data)
    shared = common_prefixes(data, suffixes)[suffixes] >= unit.window
    shared[0] = False
    group = np.cumsum(~shared) - 1
    # Members of groups: suffixes that share a window with a neighbour.
    member = shared | np.append(shared[1:], False)
    at, group = suffixes[member], group[member]
    row = np.searchsorted(begins, at, side="right") - 1
    # A prefix that runs on into the next region is no window.
    inside = at - begins[row] < n[row]
    at, group, row = at[inside], group[inside], row[inside]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = lo[row] + at - begins[row]
    document = np.unique(key, return_inverse=True)[1]
    when = document[row] << 32 | start
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    first = np.repeat(np.minimum.reduceat(when, new), np.diff(np.append(new, len(group))))
    later = np.sort(at[when > first])
    if not len(later):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(begins, later, side="right") - 1
    new = np.flatnonzero(np.concatenate([[True], (np.diff(later) != 1) | (np.diff(row) != 0)]))
    count = np.diff(np.append(new, len(later)))
    row, later = row[new], later[new]
    return row, packed(version[row], 0, count, lo[row] + later - begins[row])


def cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parted(batches):
        rows = []
        for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
            data = (text or "").encode()
            if not cuts:
                rows.append((len(data), 0, 0, data))
                continue
            gone = covered(len(data), cuts)
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(data), int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()))
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row of `docs` (doc_id, text)."""
    unit = Unit(window, gram, words=False)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    return without_repeats(docs, unit, compare(unit), cut_bytes, schema)


def cut_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents (doc_id, text, lang, source, n_chars) without repeated bytes.

    A character stays if all of its bytes stay. Documents of which nothing stays are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            texts = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist()):
                if cuts:
                    data = np.frombuffer(text.encode(), np.uint8)
                    text = data[~covered(len(data), cuts)].tobytes().decode(errors="ignore")
                texts.append(text or "")
            lengths = pa.array([len(text) for text in texts], pa.int64())
            columns = [batch.column("doc_id"), pa.array(texts, pa.string()), batch.column("lang"), batch.column("source"), lengths]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "lang", "source", "n_chars"])

    unit = Unit(window, gram, words=False)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return without_repeats(docs, unit, compare(unit), cut, schema, lang="string", source="string").where("n_chars > 0")


def digest(result: DataFrame) -> DataFrame:
    return result.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
