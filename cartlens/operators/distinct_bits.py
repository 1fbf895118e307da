"""Exact distinct counts that merge: which ids a group saw, as bits.

Ids get whole numbers in a written dictionary. The ids of a group are then bits in words of 64: one row per group
and word. Words of the same group from different days (or files, or regions) merge by a bitwise or, and the number
of bits set is the distinct count. All of it is aggregation of longs in generated code. A group with few ids has a
few words; a group that saw everything has one word per 64 ids, spread over tasks by word, so no group is hot.
Numbers given side by side to ids that stand together keep the words few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.operators.ranking import running_total

WORD_BITS = 6


def number_ids(ids: DataFrame, order: Sequence[str], first: int = 0) -> DataFrame:
    """`ids` with `number`: `first`, `first` + 1, … by `order`, which identifies a row; nulls in it come first."""
    counted = ids.withColumns({"everything": F.lit(0), "one": F.lit(1)})
    numbered = running_total(counted, ["everything"], order, "one")
    return numbered.select(*ids.columns, (F.col("upto") - 1 + first).cast("bigint").alias("number"))


def bit_words(rows: DataFrame, keys: Sequence[str], column: str, numbers: DataFrame) -> DataFrame:
    """`keys`, `word` and `bits`: the values of `column` that stand beside each combination of keys.

    `numbers` holds (`column`, number) of every value, null excepted, which is not counted. Only distinct
    combinations meet the dictionary. Null keys are keys like others."""
    seen = rows.where(F.col(column).isNotNull()).select(*keys, column).distinct()
    word, bit = F.shiftright("number", WORD_BITS), F.col("number").bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    numbered = seen.join(numbers.select(column, "number"), column).select(*keys, word.alias("word"), bit.alias("bit"))
    return numbered.groupBy(*keys, "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))


def count_bits(words: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """`keys` and `name`, the number of different values in all their words together."""
    merged = words.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))
    return merged.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("bigint").alias(name))
