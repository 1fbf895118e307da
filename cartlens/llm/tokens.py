"""Token counts of a lower-casing BPE vocabulary with word ends, by finite-state transducers.

Splitting text into words is a small deterministic transducer over classes of characters. Its
transitions carry what they emit: where a word starts. Every class is a map from state to state, and
the maps are closed under composition into a small monoid, compiled once with its multiplication
table. A batch of text is cut into equal chunks; each chunk's state map is the product of its
characters' maps, a prefix scan over the chunks gives the state each chunk starts in, and with it all
transitions are known at once. Words then are arcs of a second transducer whose outputs are
numbers of emitted tokens, compiled from the merges when a word is first met.

Null and empty texts have 0 bytes and 0 tokens; every input row gives one row, whatever its id.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers

from cartlens.llm.common import by_bytes, parted, pick

LIMIT = 2048

# Classes of characters. Letters that end an English contraction have classes of their own.
SPACE, LETTER, DIGIT, OTHER, QUOTE, STMD, R, V, L, E = range(10)
# States: nothing open, in letters, in other characters, after a leading quote, after quote and r, v or l.
FRESH, LETTERS, OTHERS, QUOTED, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
# What a transition emits: a word starts at this character, or at the one before.
HERE, BEFORE = 1, 2

# The characters with the property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Words kept in a worker's second transducer; beyond that it starts anew. Bounds memory, not results.
ARCS = 300_000
# Characters in a chunk of the scan.
CHUNK = 512

SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of `docs` (doc_id, text).

    `vocabulary` is the path of a tokenizers file; it must exist on every worker.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(vocabulary)
        for batch in parted(batches):
            texts = [text or "" for text in batch.column("text").to_pylist()]
            n_bytes = [len(text.encode()) for text in texts]
            n_tokens = [n for a, b in by_bytes(n_bytes) for n in counter.counts(texts[a:b])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = pick(docs, doc_id="long", text="string").mapInArrow(count, SCHEMA)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def step(state: int, kind: int) -> tuple[int, int]:
    """Next state and emission of the word-splitting transducer."""
    if state == QUOTED and kind == STMD:
        return FRESH, 0
    if state == QUOTED and kind in (R, V, L):
        return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[kind], 0
    if (state, kind) in ((QUOTE_R, E), (QUOTE_V, E), (QUOTE_L, L)):
        return FRESH, 0
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):  # no contraction after all: letters began one character ago
        after, emitted = step(LETTERS, kind)
        return after, emitted | BEFORE
    if kind == SPACE:
        return FRESH, 0
    if kind == DIGIT:
        return FRESH, HERE
    if kind in (OTHER, QUOTE):
        if state in (OTHERS, QUOTED):
            return OTHERS, 0
        return (QUOTED if kind == QUOTE else OTHERS), HERE
    return LETTERS, 0 if state == LETTERS else HERE


class Transducer:
    """The splitting transducer with its compiled monoid of state maps."""

    states, kinds = 7, 10

    def __init__(self) -> None:
        table = [[step(s, k) for k in range(self.kinds)] for s in range(self.states)]
        self.emits = np.array([[out for _, out in row] for row in table], np.uint8)
        maps = {tuple(range(self.states)): 0}
        of_kind = []
        for k in range(self.kinds):
            of_kind.append(maps.setdefault(tuple(row[k][0] for row in table), len(maps)))
        known = list(maps)
        for first in known:  # grows while it is read: closure under composition
            for k in range(self.kinds):
                product = tuple(table[s][k][0] for s in first)
                if product not in maps:
                    maps[product] = len(maps)
                    known.append(product)
        size = len(known)
        assert size < 2**16
        self.maps = np.array(known, np.uint8)
        self.of_kind = np.array(of_kind, np.uint16)
        self.product = np.array(
            [[maps[tuple(b[s] for s in a)] for b in known] for a in known], np.uint16
        ).reshape(size * size)
        self.size = size

    def scan(self, x: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Products of all prefixes of the maps `x` (each including its own)."""
        if len(x) <= 1:
            return x.copy()
        rows = -(-len(x) // chunk)
        padded = np.zeros(rows * chunk, np.uint16)  # identity fills up
        padded[: len(x)] = x
        # Columns are chunks: a step of the loop takes one character of each.
        grid = np.ascontiguousarray(padded.reshape(rows, chunk).T)
        for i in range(1, chunk):
            grid[i] = self.product[grid[i - 1].astype(np.int64) * self.size + grid[i]]
        if rows > 1:
            before = np.zeros(rows, np.uint16)
            before[1:] = self.scan(grid[-1], min(chunk, max(2, rows // 2)))[:-1]
            grid = self.product[before.astype(np.int64)[None, :] * self.size + grid]
        return grid.T.reshape(-1)[: len(x)]

    def starts(self, kinds: np.ndarray) -> np.ndarray:
        """Places where words start, in order; the last character must be white space."""
        after = self.maps[self.scan(self.of_kind[kinds]), FRESH]
        state = np.empty(len(kinds), np.uint8)
        state[0], state[1:] = FRESH, after[:-1]
        out = self.emits[state, kinds]
        begins = (out & HERE) > 0
        begins[:-1] |= (out[1:] & BEFORE) > 0
        return np.flatnonzero(begins)


class TokenCounter:
    """Counts of the tokens that the vocabulary file's own library gives."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials)))
        self.transducer = Transducer()
        self.kind = character_kinds()
        # The merges as ranks over bytes. A word's end is the byte 255, which no UTF-8 text has: joined
        # to the last character first, as the symbols with word end come before all merges.
        byte_of, end = {c: b for b, c in byte_names().items()}, spec["model"]["end_of_word_suffix"]
        ranks = {bytes([255]): len(spec["model"]["vocab"])}
        for token, rank in spec["model"]["vocab"].items():
            if token in self.specials:
                continue
            ends = token.endswith(end) and token != end
            raw = bytes(byte_of[c] for c in (token[: -len(end)] if ends else token))
            ranks[raw + b"\xff" * ends] = rank
        self.encode = tiktoken.Encoding("ranks", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
        self.arcs: dict[str, int] = {}

    def emitted(self, word: str) -> int:
        """Output of a word's arc: its number of tokens."""
        n = self.arcs[word] = len(self.encode._core_bpe.encode_single_piece(word.encode() + b"\xff"))
        return n

    def counts(self, texts: list[str]) -> list[int]:
        pieces, owners, totals = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if "<|" in text:
                parts = self.special.split(text)
                totals[i] += len(parts) - 1
            else:
                parts = [text]
            for part in parts:
                pieces.append(normalized(part))
                owners.append(i)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1
        whole = " ".join(pieces) + " "
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kind[points]
        starts = self.transducer.starts(kinds)
        if not len(starts):
            return totals.tolist()
        # A word ends where the next begins or at white space.
        breaks = np.zeros(len(kinds) + 1, bool)
        breaks[:-1] = kinds == SPACE
        breaks[starts] = True
        places = np.flatnonzero(breaks)
        ends = places[np.searchsorted(places, starts, side="right")]
        words = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(self.arcs) > ARCS:
            self.arcs.clear()
        known = self.arcs.get
        n = np.fromiter((known(w) or self.emitted(w) for w in words), np.int64, len(words))
        owner = np.asarray(owners)[np.searchsorted(np.cumsum(lengths), starts, side="right")]
        totals += np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)
        return totals.tolist()


@functools.lru_cache(maxsize=4)
def compiled(vocabulary: str) -> TokenCounter:
    """One counter per vocabulary and worker, kept between tasks."""
    return TokenCounter(vocabulary)


@functools.lru_cache(maxsize=1)
def unknown_points() -> np.ndarray:
    """True for code points that Python's Unicode tables do not know; the library's may be newer."""
    return np.array([unicodedata.category(chr(point)) == "Cn" for point in range(0x110000)])


LIBRARY = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def normalized(text: str) -> str:
    """Canonical composition and lower case, each character on its own as the library does it."""
    if text.isascii():
        return text.lower()
    if unknown_points()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
        return LIBRARY.normalize_str(text)
    # Lower-casing a whole string gives a final sigma at word ends.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def in_class(points: list[str], pattern: str) -> np.ndarray:
    """True for the characters that the library puts into a class."""
    marked = normalizers.Replace(Regex(pattern), "\n")
    steps = range(0, len(points), 4096)
    return np.array([c == "\n" for i in steps for c in marked.normalize_str("".join(points[i : i + 4096]))])


def character_kinds() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))[0]
        if category in "LN":
            kinds[point] = LETTER if category == "L" else DIGIT
    unknown = np.flatnonzero(unknown_points())
    newer = [chr(point) for point in unknown]
    kinds[unknown[in_class(newer, r"\p{L}")]] = LETTER
    kinds[unknown[in_class(newer, r"\p{N}")]] = DIGIT
    kinds[[ord(c) for c in WHITE_SPACE]] = SPACE
    for letters, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE)):
        kinds[[ord(c) for c in letters]] = kind
    return kinds


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    rest = itertools.count(256)
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}
