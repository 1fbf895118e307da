"""Exact order statistics over any number of rows: running totals, quantile buckets, medians.

A window without partitioning would pull all rows into one task. Here rows are range-partitioned,
each slice is numbered on its own and the totals of the slices before it are added. Slices are cut
by Spark from a sample; where they fall changes the balance of the work, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.sources.stage import stage


def running_total(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str) -> DataFrame:
    """`df` with `upto`, the sum of `weight` over the rows of the same group up to this one, and
    `overall`, that sum over the whole group.

    `group` holds no nulls and (`group`, `order`) identifies a row; nulls in `order` come first.
    """
    # The slice number must be the same for both readers below, so it is written down with the row.
    # Without a fixed number of slices the adaptive planner merges neighbouring small ones.
    sliced = stage(df.repartitionByRange(*group, *order).withColumn("slice", F.spark_partition_id()), "running-total")
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and slice: these windows see at most as many rows as there are slices.
    slice_starts = (
        sliced.groupBy(*group, "slice")
        .agg(F.sum(weight).alias("in_slice"))
        .select(
            *group,
            "slice",
            F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)).alias("before_slice"),
            F.sum("in_slice").over(Window.partitionBy(*group)).alias("overall"),
        )
    )
    within = Window.partitionBy(*group, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.join(slice_starts, [*group, "slice"])
        .withColumn("upto", F.col("before_slice") + F.sum(weight).over(within))
        .drop("slice", "before_slice")
    )


def quantile_buckets(df: DataFrame, measures: Sequence[str], key: str, buckets: int) -> DataFrame:
    """`df` with one `<measure>_bucket` column (1 = lowest) per measure, equal-sized by rank.

    Ranks are taken over (measure, key), so ties go to the smaller key. Bucket b ends at rank
    1 + floor(b * (n - 1) / buckets). Null when there are fewer than two rows, where equal-sized
    buckets are not defined. `df` should be a staged table or a cheap view of one: it is read twice.

    Only the rows at the bucket ends are looked up; every row is then compared with those few cut
    points, so the table itself is neither sorted nor shuffled for its scores.
    """
    compared = "decimal(38,6)"
    long = df.select(
        F.col(key).alias("tie"),
        F.inline(
            F.array(
                *[F.struct(F.lit(m).alias("measure"), F.col(m).cast(compared).alias("value")) for m in measures]
            )
        ),
    ).withColumn("one", F.lit(1))
    ranked = running_total(long, ["measure"], ["value", "tie"], "one")

    ends = range(1, buckets)
    cut = F.struct("value", "tie")
    # upto - 1 == floor(b * (overall - 1) / buckets), in whole numbers.
    at_end = {
        b: (b * (F.col("overall") - 1) - buckets * (F.col("upto") - 1)).between(0, buckets - 1) for b in ends
    }
    any_end = at_end[1]
    for b in ends:
        any_end = any_end | at_end[b]
    # One row holding every cut point: it reaches the plan below as a scalar, not as a join.
    cuts = (
        ranked.where(any_end)
        .agg(
            F.struct(
                F.max("overall").alias("rows"),
                *[
                    F.max(F.when((F.col("measure") == m) & at_end[b], cut)).alias(_cut_name(m, b))
                    for m in measures
                    for b in ends
                ],
            )
        )
        .scalar()
    )
    with_cuts = df.withColumn("cuts", cuts)
    for m in measures:
        here = F.struct(F.col(m).cast(compared).alias("value"), F.col(key).alias("tie"))
        bucket = F.lit(1)
        for b in ends:
            bucket = bucket + (here > F.col("cuts").getField(_cut_name(m, b))).cast("int")
        with_cuts = with_cuts.withColumn(f"{m}_bucket", F.when(F.col("cuts").getField("rows") >= 2, bucket))
    return with_cuts.drop("cuts")


def exact_median(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Group columns and `median` (double, nulls ignored) of a decimal or whole-number column.

    Equal values are folded into one row with their number before anything is sorted, and the middle is
    found in the running totals of those rows: one plan for any size and any number of digits.
    """
    keys = [*group, "everything"]
    folded = (
        df.where(F.col(value).isNotNull())
        .select(*group, F.lit(0).alias("everything"), F.col(value).alias("value"))
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    ranked = running_total(folded, keys, ["value"], "times")

    def at(position: Column) -> Column:
        covers = (F.col("upto") >= position) & (F.col("upto") - F.col("times") < position)
        return F.max(F.when(covers, F.col("value").cast("double")))

    middle = ranked.groupBy(*keys).agg(
        at(F.floor((F.col("overall") + 1) / 2)).alias("lower"), at(F.floor((F.col("overall") + 2) / 2)).alias("upper")
    )
    return middle.select(*group, ((F.col("lower") + F.col("upper")) / 2).alias("median"))


def first_rows(df: DataFrame, order: Sequence[str | Column], limit: int | None = None) -> DataFrame:
    """The first `limit` rows by `order` (ascending, nulls last); without a limit all rows, unsorted.

    Expressions are computed once a row, before the sort: a sort evaluates its order at every comparison.
    """
    if limit is None:
        return df
    computed = {f"__order_{i}": column for i, column in enumerate(order) if not isinstance(column, str)}
    names = [column if isinstance(column, str) else f"__order_{i}" for i, column in enumerate(order)]
    ordered = df.withColumns(computed).orderBy(*[F.col(name).asc_nulls_last() for name in names])
    return ordered.limit(limit).select(df.columns)


def _cut_name(measure: str, bucket: int) -> str:
    return f"{measure}_{bucket}"
