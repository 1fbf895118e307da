"""CSV records with line breaks in quoted fields, read by many tasks per file.

Whether a line break ends a record depends on the quotes before it, back to the start of the file. But seen from the
start of a line there are two cases only: outside of quotes, or inside a quoted field. So

1. every byte range is read once to find what either case at its first line leads to after its last one;
2. these steps are composed over the ranges of a file, which tells in which case each range begins;
3. every range is read again and cut into records. A record that runs over the end of its range is put together
   from the fragments that the ranges hold of it.

Step 2 takes one row per range (some 128 MB of text), as the planner holds them anyway. The ranges are those of
Spark's text reader. Should they be cut differently the second time (executors came or went, with small files), the
records are read once more; it is never passed over.

A quote opens a field only where the field begins; within quotes a doubled quote stands for one; what follows a
closing quote up to the next comma belongs to the field. Lines end with a line feed, with or without a carriage
return before it. Empty lines outside of quotes are skipped, and so is the header, the first record of each file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.sources.stage import stage

CHANGED = "the files were split into other ranges than before"
ATTEMPTS = 5

# The rest of a quoted field up to its end; a field that is complete with its comma.
_INSIDE = r'(?>[^"]+|"")*+'
_FIELD = rf'(?>"{_INSIDE}"(?>[^",][^,]*+)?|[^",][^,]*+|),'
# A line that begins outside of quotes, or behind the end of a quoted field, and ends inside of them.
_OPENS = re.compile(rf'(?>{_FIELD})*+"{_INSIDE}', re.DOTALL)
_CLOSES = re.compile(rf'{_INSIDE}"(?>[^",][^,]*+)?', re.DOTALL)

STEP = "file long, range long, from_outside boolean, from_inside boolean, ends boolean"
PIECE = "record string, file long, range long, owner long, header boolean"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, given whether it begins in one."""
    at = 0
    if inside:
        closed = _CLOSES.match(line)
        if closed is None:
            return True
        at = closed.end()
        if at == len(line):
            return False
        at += 1  # the comma
    return _OPENS.fullmatch(line, at) is not None


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line, file and range (its first byte) of all lines, in order within each range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("value").alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """(file, range, lines) of neighbouring lines of one range."""
    for batch in batches:
        file, start = batch.column("file").to_numpy(), batch.column("range").to_numpy()
        if not len(file):
            continue
        new = np.flatnonzero(np.append(True, (file[1:] != file[:-1]) | (start[1:] != start[:-1])))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(file)]):
            yield int(file[a]), int(start[a]), batch.column("line").slice(a, b - a)


def _with_quotes(text: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.match_substring(text, '"')).to_pylist()


def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STEP rows: whether each range ends inside of quotes if it begins outside of them, and if it begins inside;
    and whether in the latter case the record it begins in ends there."""
    found: dict[tuple[int, int], list[bool]] = {}
    for file, start, text in _runs(batches):
        case = found.setdefault((file, start), [False, True, False])
        for i in _with_quotes(text):
            line = text[i].as_py()
            same = case[0] == case[1]
            case[0] = ends_inside(line, case[0])
            case[1] = case[0] if same else ends_inside(line, case[1])
            case[2] |= not case[1]
    if found:
        rows = [(file, start, *case) for (file, start), case in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[c.split()[0] for c in STEP.split(", ")])


def composed(rows: list[tuple[int, int, bool, bool, bool]]) -> dict[tuple[int, int], tuple[bool, int]]:
    """By (file, range): whether it begins inside of quotes, and the range in which that record began."""
    out: dict[tuple[int, int], tuple[bool, int]] = {}
    last, inside, owner = None, False, 0
    for file, start, from_outside, from_inside, ends in sorted(rows):
        if file != last:
            last, inside = file, False
        out[file, start] = (inside, owner if inside else start)
        if not inside or ends:
            owner = start
        inside = from_inside if inside else from_outside
    return out


class Range:
    """Cuts the lines of one range into rows of PIECE."""

    def __init__(self, file: int, start: int, inside: bool, owner: int) -> None:
        self.file, self.start, self.inside, self.owner = file, start, inside, owner
        # The lines so far of an open record; whether it was open before this range.
        self.open: list[str] = []
        self.continued = inside
        self.header = start == 0

    def row(self, record: str, owner: int | None) -> tuple:
        return record, self.file, self.start, owner, self.header

    def records(self, lines: list[str], quoted: list[int]) -> Iterator[tuple]:
        done = 0
        for i in [*quoted, len(lines)]:
            if self.inside:
                self.open += lines[done:i]
            else:
                yield from self.whole(lines[done:i])
            if i == len(lines):
                return
            done = i + 1
            self.open.append(lines[i])
            self.inside = ends_inside(lines[i], self.inside)
            if self.inside:
                continue
            text, self.open = self.open, []
            if self.continued:
                yield self.row("\n".join(text).removesuffix("\r"), self.owner)
                self.continued, self.owner = False, self.start
            else:
                yield from self.whole(["\n".join(text)])

    def whole(self, texts: list[str]) -> Iterator[tuple]:
        for text in texts:
            if record := text.removesuffix("\r"):
                yield self.row(record, None)
                self.header = False

    def rest(self) -> Iterator[tuple]:
        """The piece of a record that goes on in the next range."""
        if self.inside:
            yield self.row("\n".join(self.open), self.owner)


def cut(begins) -> Callable:
    """PIECE rows: whole records (no owner), and the pieces that ranges hold of a record that began in `owner`."""

    def batch(rows: Iterator[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PIECE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = begins.value
        current = None
        for file, start, text in _runs(batches):
            if current is None or (current.file, current.start) != (file, start):
                if current is not None:
                    yield batch(current.rest())
                if (file, start) not in known:
                    raise RuntimeError(CHANGED)
                current = Range(file, start, *known[file, start])
            yield batch(current.records(text.to_pylist(), _with_quotes(text)))
        if current is not None:
            yield batch(current.rest())

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file or a folder of files, without headers (`record`), written down."""
    text = lines(spark, path)
    for attempt in range(ATTEMPTS):
        found = composed([tuple(row) for row in text.mapInArrow(steps, STEP).collect()])
        try:
            pieces = stage(text.mapInArrow(cut(spark.sparkContext.broadcast(found)), PIECE), "csv-records")
            break
        except Exception as error:  # the worker's error arrives wrapped
            if CHANGED not in str(error) or attempt == ATTEMPTS - 1:
                raise
    parts = pieces.where(F.col("owner").isNotNull()).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("range", "record"))).alias("parts"), F.bool_or(F.col("header") & (F.col("range") == F.col("owner"))).alias("header")
    )
    whole = pieces.where(F.col("owner").isNull()).select("record", "header")
    together = parts.select(F.array_join("parts.record", "\n").alias("record"), "header")
    return whole.unionByName(together).where(~F.col("header")).select("record")
