"""What the operators of this package share: picking columns, reading tables, slicing batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.sources.stage import stage

__all__ = ["HELD_OUT", "SLICE_BYTES", "WORD", "by_bytes", "documents", "held_out", "parted", "pick", "read", "stage"]

# A word: a run of characters other than the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"

# Text handled at once inside a Python worker; bounds the memory of the arrays derived from it.
SLICE_BYTES = 2 << 20

HELD_OUT = 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, cast to the given types.

    Columns are found by exact name and position, so further columns of the input may have any name,
    also one that differs in case only or that an operator uses itself.
    """
    places = {name: df.columns.index(name) for name in columns}
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{places[name]}").cast(kind).alias(name) for name, kind in columns.items()])


def documents(docs: DataFrame) -> DataFrame:
    """The columns of documents alone, whatever else there is."""
    return pick(docs, doc_id="long", text="string", lang="string", source="string", n_chars="long")


def held_out(doc_id="doc_id"):
    """True for the fifth of the documents that no model may learn from; a null id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(True))


def by_bytes(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows of at most `limit` bytes together, or of a single larger row."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total + size > limit and i > start:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def parted(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each are at most `limit` bytes, or one row: Python objects and arrays
    made of them stay small, however many rows Spark sends at once."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for start, end in by_bytes(sizes, limit):
            yield batch.slice(start, end - start)
