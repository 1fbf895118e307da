"""Equal-width histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """bin (1..bins), lower, upper, row_count over [min, max] of the non-null values, empty bins
    included. The last bin is closed on the right; a constant column gets a unit range around it."""
    values = df.select(value.cast("double").alias("value")).where(F.col("value").isNotNull())
    span = values.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high"))).scalar()
    low, high = F.col("span").getField("low"), F.col("span").getField("high")
    constant = low == high
    start = F.when(constant, low - 0.5).otherwise(low)
    end = F.when(constant, high + 0.5).otherwise(high)
    width = (end - start) / bins

    def edge(number: Column) -> Column:
        return start + (number - 1) * width

    # The scaled position can miss a value that lies on an edge by one bin: the edges decide.
    guess, value_of = F.col("guess"), F.col("value")
    settled = (
        F.when((guess > 1) & (value_of < edge(guess)), guess - 1)
        .when((guess < bins) & (value_of >= edge(guess + 1)), guess + 1)
        .otherwise(guess)
    )
    filled = (
        values.withColumn("span", span)
        .withColumn("guess", F.least(F.width_bucket("value", start, end, F.lit(bins)), F.lit(bins)))
        .groupBy(settled.alias("bin"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    spine = (
        df.sparkSession.range(1, bins + 1)
        .select(F.col("id").alias("bin"))
        .withColumn("span", span)
        .where(F.col("span").getField("low").isNotNull())
    )
    return spine.join(filled, "bin", "left").select(
        "bin",
        edge(F.col("bin")).alias("lower"),
        F.when(F.col("bin") == bins, end).otherwise(edge(F.col("bin") + 1)).alias("upper"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )
