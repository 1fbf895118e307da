"""What repeats across documents: candidates for windows that also start earlier.

Shared by the two operators that cut repeated passages. A text is a sequence of elements (bytes or
words). A window of `window` elements is judged repeated if the same window starts earlier, in a
document with a smaller id or further left in the same document.

1. Winnowing. In every window the `gram` of elements with the smallest hash is its anchor. Equal windows
   have equal anchors at the same place, and neighbouring windows mostly share one. The windows of an
   anchor are a region: one row with the hash of the anchor and the hash of the region.
2. Meeting. Rows of an anchor meet in sorted order. An anchor without a second row has no repeats. Where
   the whole region is equal to an earlier one, all its windows are repeated. The first rows of
   regions that differ are candidates, which the operator compares by content.
3. Anchors with very many different regions are not compared in one place: their windows are told apart
   one by one and counted over all tasks.

Rows of equal regions are folded within each slice of text before they are shuffled, so what very many
documents share arrives as one row per slice. Very long texts are cut into overlapping segments.

Texts are held apart by id and 80 bits of hashes of the text (64 in `hash`, 16 in `version`, which also has
the length): rows that share an id are one document as far as order goes, and equal places in them do not
count as earlier, but cuts go back to the text they came from. A null id comes after all others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import by_bytes, parted, pick, stage

SEGMENT = 1 << 20
# Regions of one anchor that are compared by content in one task.
WIDE = 4096
# Rows of a partition that are handled at once.
ROWS = 200_000
NULL_KEY = (1 << 63) - 1
PLACE = (1 << 28) - 1
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
WHITE_BYTE = re.compile(rb"[\x09-\x0d\x20]")
REMOVED, CANDIDATE, SINGLE = 0, 1, 2

_draw = np.random.default_rng(20240229)
TABLES = _draw.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
# Odd bases that differ from 1 by 2 times an odd number: powers repeat as late as they can.
BASES = tuple(int(x) * 8 + 3 for x in _draw.integers(1 << 58, 1 << 60, 2, dtype=np.uint64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads hashes over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            column = np.full(size, b, np.uint64)
            column[0] = 1
            both.append(np.cumprod(column, dtype=np.uint64))
        known = _powers[base] = tuple(both)
    return known


class Sums:
    """Hashes of any stretch of a sequence, from sums over its beginnings."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


@dataclass(frozen=True)
class Unit:
    """Elements of a text and the lengths of windows and grams in them."""

    window: int
    gram: int
    words: bool

    @property
    def choices(self) -> int:
        return self.window - self.gram + 1

    def elements(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each element of all parts, and where each part starts (and the last ends)."""
        if not self.words:
            data = np.frombuffer(b"".join(parts), np.uint8)
            return TABLES[0][data], TABLES[1][data], np.cumsum([0, *map(len, parts)])
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        starts, ends = word_bounds(data)
        hashes = [mixed(Sums(TABLES[i][data], BASES[i]).of(starts, ends) + np.uint64(i + 1)) for i in (0, 1)]
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        return hashes[0], hashes[1], np.searchsorted(starts, begins)

    def segments(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        """(number of the first element, bytes) of overlapping parts of a text that hold all windows."""
        if not self.words:
            step = SEGMENT - self.window + 1
            for at in range(0, max(len(data) - self.window + 1, 1), step):
                yield at, data[at : at + SEGMENT]
            return
        at = base = 0
        size = SEGMENT
        while len(data) - at > size:
            white = WHITE_BYTE.search(data, at + size)
            if white is None:
                break
            starts, _ = word_bounds(np.frombuffer(data[at : white.start()], np.uint8))
            if len(starts) <= self.window:
                size *= 2
                continue
            yield base, data[at : white.start()]
            again = len(starts) - self.window + 1
            at, base, size = at + int(starts[again]), base + again, SEGMENT
        yield base, data[at:]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = WHITE[data]
    return np.flatnonzero(white[:-1] & ~white[1:]), np.flatnonzero(~white[:-1] & white[1:])


def packed(version, off, n, lo) -> np.ndarray:
    """One number for a region: 16 bits of the text's hash, place of the anchor, windows, first element."""
    version, off, n, lo = (np.asarray(x).astype(np.int64) for x in (version, off, n, lo))
    return ((version << 8 | off) << 8 | n) << 31 | lo


def unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = x & ((1 << 63) - 1)
    return x >> 47, x >> 39 & 255, x >> 31 & 255, x & ((1 << 31) - 1)


def regions(unit: Unit, parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """part, first window, windows, place of the anchor, anchor hash, region hash of all regions."""
    first, second, bounds = unit.elements(parts)
    n = len(first)
    if n < unit.window:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    grams = Sums(first, BASES[0]).all_of(unit.gram)
    keys = mixed(grams) & ~np.uint64(PLACE) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keys, unit.choices)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(len(least)) + unit.window <= ends[: len(least)])
    anchors = (least[starts] & np.uint64(PLACE)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]])) if len(starts) else starts
    lo, anchor = starts[new], anchors[new]
    count = np.diff(np.append(new, len(starts)))
    part = np.searchsorted(bounds, lo, side="right") - 1
    whole = Sums(second, BASES[1]).of(lo, lo + count + unit.window - 1)
    return part, lo - bounds[part], count, anchor - lo, grams[anchor], mixed(whole + count.astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: running minima of blocks from both sides."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    # Blocks as columns: each step of the running minimum is one pass over a row.
    blocks = np.ascontiguousarray(padded.reshape(-1, w).T)
    forward = np.ascontiguousarray(np.minimum.accumulate(blocks, axis=0).T).reshape(-1)
    backward = np.ascontiguousarray(np.minimum.accumulate(blocks[::-1], axis=0)[::-1].T).reshape(-1)
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def repeats_of(same: tuple[np.ndarray, ...]) -> np.ndarray:
    """True where sorted rows equal the row before in all columns."""
    equal = np.zeros(len(same[0]), bool)
    equal[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in same])
    return equal


ROW = "h long, r long, key long, hash long, place long"
MET = "kind int, h long, key long, hash long, place long"
FOUND = "key long, hash long, place long"
# What tells texts apart.
TEXT = ("key", "hash", "version")


def keyed(docs: DataFrame, **more: str) -> DataFrame:
    """key, hash, version, doc_id, text and the columns `more` of every row."""
    rows = pick(docs, doc_id="long", text="string", **more)
    # Another seed and the length: independent of `hash`. Never null, which Spark has to be told: else the inner join
    # filters nulls before it shuffles the texts, the left join does not, and neither takes the other's exchange.
    version = F.coalesce(F.pmod(F.xxhash64(F.lit(1), F.octet_length("text"), "text"), F.lit(1 << 16)), F.lit(0))
    key = F.coalesce("doc_id", F.lit(NULL_KEY))
    return rows.select(key.alias("key"), F.xxhash64("text").alias("hash"), version.alias("version"), *rows.columns)


def winnowed(unit: Unit) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            keys = batch.column("key").to_numpy()
            hashes = batch.column("hash").to_numpy()
            versions = batch.column("version").to_numpy()
            parts, owners, bases = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for base, part in unit.segments((text or "").encode()):
                    parts.append(part)
                    owners.append(i)
                    bases.append(base)
            owners, bases = np.array(owners, np.int64), np.array(bases, np.int64)
            for a, b in by_bytes([len(p) for p in parts]):
                part, lo, n, off, h, r = regions(unit, parts[a:b])
                row, lo = owners[a + part], lo + bases[a + part]
                key = keys[row]
                order = np.lexsort((lo, key, r, h))
                key, lo, n, off, h, r = (x[order] for x in (key, lo, n, off, h, r))
                row = row[order]
                place = packed(versions[row], off, n, lo)
                # An equal region of the same slice comes before: decided, and dealt by any key.
                done = repeats_of((h, r)) & ~repeats_of((h, r, key, lo))
                place[done] |= -(1 << 63)
                h[done] = mixed(key[done].astype(np.uint64) * np.uint64(31) + lo[done].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(r.view(np.int64)), pa.array(key), pa.array(hashes[row]), pa.array(place)],
                    names=["h", "r", "key", "hash", "place"],
                )

    return run


def met_rows(h, r, key, text, place) -> tuple[np.ndarray, ...]:
    """What rows that share anchors say: kind, h, key, hash, place; single rows say nothing."""
    done = place < 0
    out = [(np.zeros(int(done.sum()), np.int32), h[done], key[done], text[done], place[done] & ((1 << 63) - 1))]
    h, r, key, text, place = (x[~done] for x in (h, r, key, text, place))
    lo = unpacked(place)[3]
    order = np.lexsort((place, text, lo, key, r, h))
    h, r, key, text, place, lo = (x[order] for x in (h, r, key, text, place, lo))
    if len(h):
        later = repeats_of((h, r))
        again = repeats_of((h, r, key, lo))
        # Equal places of rows that share an id are as early as each other.
        first = ~later
        for_first = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        early = (key == key[for_first]) & (lo == lo[for_first])
        gone = later & ~early
        out.append((np.zeros(int(gone.sum()), np.int32), h[gone], key[gone], text[gone], place[gone]))
        group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        different = np.bincount(group, first)
        start = early & (different[group] > 1) & ~(again & repeats_of((text, place)))
        kind = np.where(different[group[start]] > WIDE, SINGLE, CANDIDATE).astype(np.int32)
        out.append((kind, h[start], key[start], text[start], place[start]))
    return tuple(np.concatenate(x) for x in zip(*out))


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by h, taken in stretches that hold whole anchors, or parts of a very wide one."""

    def batch_of(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "h", "key", "hash", "place"])

    def part(rows, start: int, end: int | None = None) -> tuple[np.ndarray, ...]:
        return tuple(x[start:end] for x in rows)

    held: list[tuple[np.ndarray, ...]] = []
    wide = None  # an anchor of which parts were given away already
    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy() for i in range(5)))
        if sum(len(x[0]) for x in held) < ROWS:
            continue
        rows = tuple(np.concatenate(x) for x in zip(*held))
        h = rows[0]
        cut = int(np.searchsorted(h, h[-1]))
        if wide is not None and (n := int(np.searchsorted(h, wide, side="right"))):
            yield batch_of(_apart(*part(rows, 0, n)))
            rows, cut = part(rows, n), max(cut - n, 0)
            h = rows[0]
        if cut:
            yield batch_of(met_rows(*part(rows, 0, cut)))
            wide = None
        if len(h) - cut >= ROWS:
            yield batch_of(_apart(*part(rows, cut)))
            wide, cut = h[-1], len(h)
        held = [part(rows, cut)]
    if held:
        rows = tuple(np.concatenate(x) for x in zip(*held))
        n = int(np.searchsorted(rows[0], wide, side="right")) if wide is not None else 0
        if n:
            yield batch_of(_apart(*part(rows, 0, n)))
        yield batch_of(met_rows(*part(rows, n)))


def _apart(h, r, key, text, place) -> tuple[np.ndarray, ...]:
    """Rows of one anchor with too many regions to be held: first ones are compared window by window."""
    done = place < 0
    lo = unpacked(place)[3]
    order = np.lexsort((lo, key, r))
    h, r, key, text, place, done, lo = (x[order] for x in (h, r, key, text, place, done, lo))
    later = repeats_of((r,)) & ~repeats_of((r, key, lo)) | done
    return np.where(later, REMOVED, SINGLE).astype(np.int32), h, key, text, place & ((1 << 63) - 1)


def meetings(docs: DataFrame, unit: Unit) -> DataFrame:
    """Decided and undecided regions of `docs` (from `keyed`), written down."""
    rows = docs.where(F.col("text").isNotNull()).select(*TEXT, "text").mapInArrow(winnowed(unit), ROW)
    return stage(rows.repartition("h").sortWithinPartitions("h").mapInArrow(meet, MET), "met")


VERSION, FIRST = "shiftright(place, 47)", "place & 2147483647"
WINDOWS = "shiftright(place, 31) & 255"


def with_texts(docs: DataFrame, found: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`function` over the texts that `found` rows point into, each with its list of (h, place)."""
    wanted = found.groupBy("key", "hash", F.expr(VERSION).alias("version")).agg(F.collect_list(F.struct("h", "place")).alias("wanted"))
    # With all columns, so that the texts are shuffled once for this and for the cuts.
    return docs.join(wanted, [*TEXT]).mapInArrow(function, schema)


def cut_regions(unit: Unit) -> Callable:
    """h, key, hash, place and content of candidate regions: bytes, or 16 bytes for each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parted(batches):
            out: list[tuple[int, int, int, int, bytes]] = []
            columns = (batch.column(c).to_pylist() for c in ("key", "hash", "text", "wanted"))
            for key, hashed, text, wanted in zip(*columns):
                data = text.encode()
                if not unit.words:
                    for w in wanted:
                        n, lo = w["place"] >> 31 & 255, w["place"] & (1 << 31) - 1
                        out.append((w["h"], key, hashed, w["place"], data[lo : lo + n + unit.window - 1]))
                    continue
                left = sorted(wanted, key=lambda w: w["place"] & (1 << 31) - 1)
                for base, part in unit.segments(data):
                    first, second, _ = unit.elements([part])
                    both, rest = np.stack([first, second], axis=1), []
                    for w in left:
                        n, lo = w["place"] >> 31 & 255, (w["place"] & (1 << 31) - 1) - base
                        end = lo + n + unit.window - 1
                        if lo >= 0 and end <= len(both):
                            out.append((w["h"], key, hashed, w["place"], both[lo:end].tobytes()))
                        else:
                            rest.append(w)
                    left = rest
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "key", "hash", "place", "content"]
            )

    return run


def single_windows(unit: Unit) -> Callable:
    """Every window of very common anchors by two hashes: key, hash, version and place of the window."""
    inner = cut_regions(unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in inner(batches):
            out = []
            for key, hashed, place, content in zip(*(batch.column(c).to_pylist() for c in ("key", "hash", "place", "content"))):
                version, _, n, lo = (int(x) for x in unpacked(np.int64(place)))
                if unit.words:
                    first, second = np.frombuffer(content, np.uint64).reshape(-1, 2).T
                else:
                    data = np.frombuffer(content, np.uint8)
                    first, second = TABLES[0][data], TABLES[1][data]
                a, b = Sums(first, BASES[0]).all_of(unit.window)[:n], Sums(second, BASES[1]).all_of(unit.window)[:n]
                whose = np.full(n, key, np.int64), np.full(n, hashed, np.int64)
                out.append((a, b, *whose, packed(version, 0, 1, lo + np.arange(n))))
            columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c.view(np.int64)) for c in columns], names=["h", "r", "key", "hash", "place"]
            )

    return run


def removed_windows(docs: DataFrame, unit: Unit, compare: Callable) -> DataFrame:
    """key, hash and place of every stretch of repeated windows of `docs` (from `keyed`).

    `compare` takes batches of h, key, hash, place, content sorted by h and gives key, hash and place.
    """
    met = meetings(docs, unit)
    out = met.where(F.col("kind") == REMOVED).select("key", "hash", "place")
    cut = with_texts(docs, met.where(F.col("kind") == CANDIDATE), cut_regions(unit), f"h long, {FOUND}, content binary")
    out = out.union(cut.repartition("h").sortWithinPartitions("h").mapInArrow(compare, FOUND))
    common = met.where(F.col("kind") == SINGLE)
    if not common.isEmpty():
        # Not written down: within one plan the texts are shuffled once for these, the candidates and the cuts.
        windows = with_texts(docs, common, single_windows(unit), ROW)
        at = F.struct("key", F.expr(FIRST).alias("lo"))
        firsts = windows.groupBy("h", "r").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        later = windows.join(firsts, ["h", "r"]).where(at > F.col("first"))
        out = out.union(later.select("key", "hash", "place"))
    return out


def cuts(removed: DataFrame, unit: Unit) -> DataFrame:
    """The stretches of each text, [first, end) in elements."""
    ranges = removed.select(
        "key", "hash", F.expr(VERSION).alias("version"),
        F.struct(F.expr(FIRST).alias("first"), F.expr(f"({FIRST}) + ({WINDOWS}) + {unit.window - 1}").alias("end")).alias("cut"),
    )
    return ranges.groupBy(*TEXT).agg(F.collect_list("cut").alias("cuts"))


def without_repeats(
    docs: DataFrame, unit: Unit, compare: Callable, function: Callable, schema: str, **more: str
) -> DataFrame:
    """`function` over doc_id, text, `more` and the stretches to cut (null: none) of every row of `docs`."""
    rows = keyed(docs, **more)
    found = cuts(removed_windows(rows, unit, compare), unit)
    joined = rows.join(found, [*TEXT], "left").drop(*TEXT)
    return joined.mapInArrow(function, schema)


def covered(n: int, cuts: list[dict] | None) -> np.ndarray:
    """True for each of n elements that a stretch covers."""
    depth = np.zeros(n + 1, np.int64)
    if cuts:
        np.add.at(depth, [c["first"] for c in cuts], 1)
        np.add.at(depth, [c["end"] for c in cuts], -1)
    return np.cumsum(depth)[:n] > 0


def whole_rows(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple]:
    """h, key, hash, place (arrays) and contents (list) of sorted rows, in stretches of about `limit` bytes
    that hold whole anchors."""
    held, size = [], 0
    for batch in batches:
        held.append((*(batch.column(i).to_numpy() for i in range(4)), batch.column(4).to_pylist()))
        size += batch.column(4).nbytes
        if size < limit:
            continue
        columns = [np.concatenate([x[i] for x in held]) for i in range(4)]
        contents = [c for x in held for c in x[4]]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield (*(c[:cut] for c in columns), contents[:cut])
        held = [(*(c[cut:] for c in columns), contents[cut:])]
        size = sum(map(len, contents[cut:]))
    if held:
        yield (*(np.concatenate([x[i] for x in held]) for i in range(4)), [c for x in held for c in x[4]])
