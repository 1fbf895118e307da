"""Fixed orders and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import named


def spine(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """The given values in order as a table (`column`, `position`), made inside the plan."""
    return df.sparkSession.range(1).select(
        F.posexplode(F.array(*map(F.lit, values))).alias("position", column)
    )


def along_spine(df: DataFrame, column: str, values: list[str], keep_absent: bool) -> DataFrame:
    """Rows of `df` (one per value) in the given order; values without a row stay as nulls or go.

    The spine has a handful of rows by construction, so broadcasting it is safe at any size of `df`.
    """
    ordered = spine(df, column, values)
    if keep_absent:
        joined = ordered.join(df, column, "left")
    else:
        joined = df.join(F.broadcast(ordered), column)
    return joined.orderBy("position").drop("position").select(*df.columns)


def count_matrix(df: DataFrame, row: str, column: str, values: list, names: list[str]) -> DataFrame:
    """Rows of `df` per `row` value, one zero-filled count column per value of `column`."""
    matrix = df.groupBy(row).pivot(column, values).count()
    return matrix.select(
        row, *[F.coalesce(named(str(value)), F.lit(0)).alias(name) for value, name in zip(values, names, strict=True)]
    )
