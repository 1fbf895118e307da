"""Table profiles: types, row counts and missing values, one pass per table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import named

# Every text that reads as a decimal is of this form. One that does not costs an error that is raised and caught.
NUMBER = r"^[\x00-\x20]*[+-]?[\p{Nd}.]+(?:[eE][+-]?\p{Nd}+)?[\x00-\x20]*$"


def null_counts(df: DataFrame, table_name: str) -> DataFrame:
    """One row per column: table_name, row_count, column_name, column_type, null_count.

    The whole table is folded into one row by a single map-side aggregate; only that row is turned
    into the long form.
    """
    counted = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.lit(kind).alias("column_type"),
                    F.count_if(named(name).isNull()).alias("null_count"),
                )
                for name, kind in df.dtypes
            ]
        ).alias("profile"),
    )
    return counted.select(F.lit(table_name).alias("table_name"), "row_count", F.inline("profile"))


def profile_all(tables: dict[str, DataFrame]) -> DataFrame:
    return _stacked([null_counts(df, name) for name, df in tables.items()])


def value_sums(df: DataFrame, table_name: str) -> DataFrame:
    """One row per column: table_name, column_name, row_count, filled (values that are not null), total
    (of the values that are numbers, to three digits) and letters (in those that are not).

    Numbers are read from their text, so a table and what was written of it as text compare equal.
    """
    columns = []
    for name in df.columns:
        text = named(name).cast("string")
        number = _number(text)
        columns.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(text).alias("filled"),
                F.round(F.sum(number), 3).cast("double").alias("total"),
                F.sum(F.when(number.isNull(), F.length(text))).alias("letters"),
            )
        )
    summed = df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*columns).alias("sums"))
    return summed.select(F.lit(table_name).alias("table_name"), "row_count", F.inline("sums"))


def value_sums_all(tables: dict[str, DataFrame]) -> DataFrame:
    return _stacked([value_sums(df, name) for name, df in tables.items()])


def row_sums(df: DataFrame, table_name: str, by_value: bool = False) -> DataFrame:
    """One row: table_name, row_count, first_sum and second_sum, two sums of 60 bits of each row's digest.

    They do not depend on the order of rows, and change if two rows exchange a value. The columns are taken by name.
    Texts count as they stand, an empty one like null; `by_value` takes numbers from their text, to three digits.
    """
    cells = []
    for name in sorted(df.columns):
        text = F.nullif(named(name).cast("string"), F.lit(""))
        if by_value:
            text = F.coalesce(F.round(_number(text), 3).cast("decimal(38,3)").cast("string"), text)
        cells.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-")))
    digest = F.md5(F.concat_ws("", *cells))

    def summed(start: int) -> Column:
        bits = F.conv(F.substring(F.col("digest"), start, 15), 16, 10).cast("decimal(19,0)")
        return F.coalesce(F.sum(bits), F.lit(0)).cast("string")

    return df.select(digest.alias("digest")).agg(
        F.lit(table_name).alias("table_name"),
        F.count(F.lit(1)).alias("row_count"),
        summed(1).alias("first_sum"),
        summed(17).alias("second_sum"),
    )


def row_sums_all(tables: dict[str, DataFrame], by_value: bool = False) -> DataFrame:
    return _stacked([row_sums(df, name, by_value) for name, df in tables.items()])


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, row_count, column_count."""
    return _stacked(
        [
            df.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count")
            )
            for name, df in tables.items()
        ]
    )


def _number(text: Column) -> Column:
    """The text as a decimal, null if it is no number."""
    return F.when(text.rlike(NUMBER), text.try_cast("decimal(38,6)"))


def _stacked(parts: list[DataFrame]) -> DataFrame:
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked
