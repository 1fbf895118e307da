"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenized, ended by END and, if longer than a sequence, cut into full pieces; the
first piece takes what is left over. Full pieces are sequences of their own. All others are dealt by
hash into blocks of about BLOCK pieces, and each block is packed by ISLANDS populations that evolve apart.
A generation's crossover injects whole well-filled bins of one parent into another, dissolves the bins
that hold the same pieces a second time, and puts the displaced pieces back by best fit. After each
of ROUNDS rounds an island's elite moves to the next island of its block. What lies in badly
filled bins of all blocks is dealt and packed once more.

Null texts are empty and one piece of END alone. Rows may repeat: every row is packed for itself.
"""

from __future__ import annotations

import array
import bisect
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import parted, pick, stage

CAPACITY = 2048
END = 0
BLOCK = 4096
ISLANDS = 2
ROUNDS = 2
POPULATION = 6
GENERATIONS = 6
ELITE = 2
# Bins at least this full may be injected; less than POOR full they are packed again with others.
WELL_FILLED = 0.998
POOR = 0.97
# Distinct words a worker keeps the ids of; beyond that it starts anew. Bounds memory, not results.
KNOWN = 150_000
NEAR_SPACE = re.compile(r"\s ")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
STATE = "block long, island int, bins int, fitness double, items array<long>, lengths array<int>, bin array<int>"


class Tokenizer:
    """Byte-level BPE with the words of a text looked up in a table of known ones."""

    def __init__(self, vocabulary: str) -> None:
        import json

        import tiktoken

        from cartlens.llm.tokens import byte_names

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {c: b for b, c in byte_names().items()}
        ranks = {
            bytes(byte_of[c] for c in token): rank
            for token, rank in spec["model"]["vocab"].items()
            if token not in self.specials
        }
        # Fixed value: how this vocabulary's library splits text.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.known: dict[str, bytes] = {}

    def _add(self, word: str) -> bytes:
        """Ids of a word after a space."""
        core = self.encoding._core_bpe
        if word.isascii() and word.isalpha():
            ids = core.encode_single_piece(b" " + word.encode())
        else:
            ids = core.encode_ordinary(" " + word)
        packed = self.known[word] = array.array("I", ids).tobytes()
        return packed

    def ids(self, text: str) -> bytes:
        """All ids as little-endian 32-bit numbers."""
        if self.special and "<|" in text:
            parts = self.special.split(text)
            if len(parts) > 1:
                return b"".join(
                    np.array([self.specials[p]], "<u4").tobytes() if i % 2 else self.ids(p) for i, p in enumerate(parts)
                )
        if NEAR_SPACE.search(text):
            return np.array(self.encoding._core_bpe.encode_ordinary(text), "<u4").tobytes()
        # A space after a character that is none always starts a piece of its own.
        first, *rest = text.split(" ")
        if len(self.known) > KNOWN:
            self.known.clear()
        get = self.known.get
        head = np.array(self.encoding._core_bpe.encode_ordinary(first), "<u4").tobytes()
        return head + b"".join([get(word) or self._add(word) for word in rest])


@functools.lru_cache(maxsize=4)
def tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer(vocabulary)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of `docs` (doc_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary)
        for batch in parted(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = words.ids(text or "") + np.array([END], "<u4").tobytes()
                n = len(data) // 4
                start, piece = 0, 0
                while start < n:
                    length = (n - start - 1) % capacity + 1 if piece == 0 else capacity
                    part = data[4 * start : 4 * (start + length)]
                    ids = [np.frombuffer(part, "<u4").astype("i4")] if with_ids else []
                    rows.append((doc_id, piece, start, length, zlib.crc32(part), *ids))
                    start, piece = start + length, piece + 1
            columns = list(zip(*rows)) if rows else [()] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = [*PIECES.replace(" long", "").replace(" int", "").split(", "), "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names[: len(columns)])

    return pick(docs, doc_id="long", text="string").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


# --- the genetic algorithm on one block -------------------------------------------------------


def best_fit(lengths: np.ndarray, bin_of: np.ndarray, loads: list[int], loose: np.ndarray, capacity: int) -> None:
    """Puts the pieces `loose` (in this order) into the fullest bin they fit in, or a new one."""
    if not len(loose):
        return
    smallest = int(lengths[loose].min())
    room = sorted((capacity - load, b) for b, load in enumerate(loads) if capacity - load >= smallest)
    for item in loose.tolist():
        length = int(lengths[item])
        at = bisect.bisect_left(room, (length, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            left, b = capacity, len(loads)
            loads.append(0)
        bin_of[item] = b
        loads[b] += length
        if left - length >= smallest:
            bisect.insort(room, (left - length, b))


def cross(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, draw: np.random.Generator) -> np.ndarray:
    """A child of `a` with some of the well-filled bins of `b`."""
    loads_b = np.bincount(b, lengths)
    good = np.flatnonzero(loads_b >= WELL_FILLED * capacity)
    if not len(good):
        good = np.flatnonzero(loads_b >= np.quantile(loads_b, 0.5))
    injected = np.zeros(len(loads_b), bool)
    injected[draw.choice(good, max(1, int(len(good) * draw.uniform(0.05, 0.35))), replace=False)] = True
    moved = injected[b]
    doubled = np.zeros(int(a.max()) + 1, bool)
    doubled[a[moved]] = True
    # The fullest bins keep what they have; a few of the worst are dissolved as well.
    loads_a = np.bincount(a, lengths)
    doubled |= (loads_a < POOR * capacity) & (draw.random(len(loads_a)) < 0.5)
    loose = np.flatnonzero(doubled[a] & ~moved)
    child = np.full(len(a), -1, np.int64)
    kept = ~doubled[a] & ~moved
    names = np.unique(a[kept])
    child[kept] = np.searchsorted(names, a[kept])
    taken = np.unique(b[moved])
    child[moved] = len(names) + np.searchsorted(taken, b[moved])
    loads = np.bincount(child[child >= 0], lengths[child >= 0]).astype(np.int64).tolist()
    order = np.lexsort((loose, -lengths[loose]))
    best_fit(lengths, child, loads, loose[order], capacity)
    return child


def fitness(bin_of: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then more uneven filling. Lower is better."""
    loads = np.bincount(bin_of, lengths)
    return len(loads), -float(((loads / capacity) ** 2).mean())


def first_population(lengths: np.ndarray, capacity: int, size: int, draw: np.random.Generator) -> list[np.ndarray]:
    """Best-fit packings in orders of decreasing length, all but the first blurred."""
    people = []
    for k in range(size):
        order = np.argsort(-lengths * (draw.uniform(1 - 0.1 * k, 1, len(lengths)) if k else 1.0), kind="stable")
        bin_of = np.zeros(len(lengths), np.int64)
        best_fit(lengths, bin_of, [], order, capacity)
        people.append(bin_of)
    return people


def evolve(people: list[np.ndarray], lengths: np.ndarray, capacity: int, draw: np.random.Generator) -> list[np.ndarray]:
    """The population after GENERATIONS, best first."""
    least = -(-int(lengths.sum()) // capacity)
    ranked = sorted(((fitness(p, lengths, capacity), i, p) for i, p in enumerate(people)), key=lambda x: x[:2])
    number = len(ranked)
    for _ in range(GENERATIONS):
        if ranked[0][0][0] <= least:
            break
        children = []
        for _ in range(POPULATION // 2):
            i, j = sorted(draw.choice(len(ranked), 2, replace=len(ranked) < 2))
            child = cross(ranked[i][2], ranked[j][2], lengths, capacity, draw)
            children.append((fitness(child, lengths, capacity), number, child))
            number += 1
        ranked = sorted([*ranked, *children], key=lambda x: x[:2])[:POPULATION]
    return [p for _, _, p in ranked]


def _settle(key: tuple, group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Founds an island from the pieces of its block."""
    group = group.sort_values("item")
    items, lengths = group["item"].to_numpy(), group["length"].to_numpy(np.int64)
    draw = np.random.default_rng([int(key[0]), int(key[1])])
    people = evolve(first_population(lengths, capacity, POPULATION, draw), lengths, capacity, draw)
    return _elite(key, items, lengths, people, capacity)


def _go_on(key: tuple, group: pd.DataFrame, capacity: int, rounds: int) -> pd.DataFrame:
    """Evolves an island from its own elite and the one that moved in."""
    group = group.sort_values(["home", "bins", "fitness"])
    items, lengths = np.array(group["items"].iloc[0]), np.array(group["lengths"].iloc[0], np.int64)
    people = [np.array(p, np.int64) for p in group["bin"]]
    draw = np.random.default_rng([int(key[0]), int(key[1]), rounds])
    return _elite(key, items, lengths, evolve(people, lengths, capacity, draw), capacity)


def _elite(key, items, lengths, people, capacity) -> pd.DataFrame:
    rows = []
    for p in people[:ELITE]:
        bins, value = fitness(p, lengths, capacity)
        rows.append((key[0], key[1], bins, value, items, lengths.astype(np.int32), p.astype(np.int32)))
    return pd.DataFrame(rows, columns=["block", "island", "bins", "fitness", "items", "lengths", "bin"])


def _of_round(capacity: int, number: int):
    return lambda key, group: _go_on(key, group, capacity, number)


def packed_blocks(items: DataFrame, capacity: int, first_block: int = 0) -> DataFrame:
    """block, item, length, bin and load of all `items` (item, length < capacity, unique item)."""
    blocks = max(1, -(-items.count() // BLOCK))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)) + first_block)
    islands = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    state = stage(islands.groupBy("block", "island").applyInPandas(lambda key, group: _settle(key, group, capacity), STATE), "islands")
    for r in range(1, ROUNDS):
        moved = state.withColumn("island", (F.col("island") + 1) % ISLANDS)
        met = state.withColumn("home", F.lit(0)).union(moved.withColumn("home", F.lit(1)))
        state = stage(met.groupBy("block", "island").applyInPandas(_of_round(capacity, r), STATE), "islands")
    best = state.groupBy("block").agg(F.min_by(F.struct("items", "lengths", "bin"), F.struct("bins", "fitness", "island")).alias("best"))
    rows = best.select("block", F.inline(F.arrays_zip("best.items", "best.lengths", "best.bin"))).toDF("block", "item", "length", "bin")
    loads = rows.groupBy("block", "bin").agg(F.sum("length").alias("load"))
    return stage(rows.join(loads, ["block", "bin"]), "packed")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece of `docs` (doc_id, text) with its sequence_id and offset there."""
    cut = stage(pieces(docs, vocabulary, capacity, with_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = cut.where(F.col("length") < capacity).select("item", F.col("length").cast("int").alias("length"))
    once = packed_blocks(items, capacity)
    poor = F.col("load") < POOR * capacity
    # Blocks of the second pass are numbered on, below the numbers of the full pieces.
    again = packed_blocks(once.where(poor).select("item", "length"), capacity, 1 << 32)
    placed = once.where(~poor).unionByName(again).withColumn("sequence_id", F.col("block") * (1 << 16) + F.col("bin"))
    # A sequence holds at most `capacity` pieces.
    upto = F.sum("length").over(Window.partitionBy("sequence_id").orderBy(F.desc("length"), "item"))
    placed = placed.select("item", "sequence_id", (upto - F.col("length")).alias("offset"))
    # Full pieces are numbered below zero.
    full = cut.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("item"), "offset": F.lit(0).cast("long")})
    rest = cut.where(F.col("length") < capacity).join(placed, "item")
    return full.unionByName(rest).drop("item")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and token ids of whole sequences, from `pack(..., with_ids=True)`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
