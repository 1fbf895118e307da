"""Group-by with exact distinct counts, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_with_distincts(
    df: DataFrame,
    keys: list[str],
    aggregates: list[Column],
    distincts: dict[str, str],
    keep_null_keys: bool = False,
) -> DataFrame:
    """Per `keys`: `aggregates`, and for each `{output: column}` the number of distinct values.

    In one aggregate, a distinct count drags every partial sum through the shuffle of the (key, value)
    pairs, of which there can be nearly as many as rows, and several of them repeat every input row
    once per count. Apart, the sums are combined before their small shuffle and the bare pairs travel
    alone, spread by key and value, so a key that owns a third of the rows is no burden to one task.
    The price is one more scan per count, of the key and value columns only.

    Null keys are dropped unless `keep_null_keys`. Without them each result is placed by the keys and
    the joins move nothing; with them use few distinct keys.
    """
    if not keep_null_keys:
        df = df.dropna(subset=keys)
    result = df.groupBy(*keys).agg(*aggregates)
    for name, column in distincts.items():
        pairs = df.where(F.col(column).isNotNull()).select(*keys, column).distinct()
        counted = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        if keep_null_keys:
            result = _join_null_safe(result, counted, keys)
        else:
            result = result.join(counted, keys, "left")
        result = result.withColumn(name, F.coalesce(name, F.lit(0)))
    return result


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({key: f"right_{key}" for key in keys})
    matches = F.lit(True)
    for key in keys:
        matches = matches & F.col(key).eqNullSafe(F.col(f"right_{key}"))
    return left.join(renamed, matches, "left").drop(*[f"right_{key}" for key in keys])


def channel_sums(attributed: DataFrame, channels: DataFrame, distincts: dict[str, str]) -> DataFrame:
    """Per channel of `channels` (campaign_id, channel): rows (`orders`), refunds, exact net revenue and its
    mean as doubles, and for each `{output: column}` the number of distinct non-null values.

    Only folded rows meet the campaigns: one row of sums per campaign, and each campaign's distinct
    values. A campaign that holds very many transactions is a single row of sums in the join. A
    campaign that is listed twice counts twice in the sums. Null channels are a group of their own.
    """
    sums = attributed.groupBy("campaign_id").agg(
        F.count("transaction_id").alias("orders"),
        F.count_if("refund_flag").alias("refunds"),
        F.sum("net_revenue").alias("net"),
        F.count("net_revenue").alias("paid"),
    )
    result = (
        sums.join(channels, "campaign_id")
        .groupBy("channel")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("refunds").alias("refunds"),
            F.sum("net").cast("double").alias("net_revenue"),
            F.try_divide(F.sum("net").cast("double"), F.sum("paid").cast("double")).alias("mean_revenue"),
        )
    )
    for name, column in distincts.items():
        pairs = attributed.where(F.col(column).isNotNull()).select("campaign_id", column).distinct()
        pairs = pairs.join(channels, "campaign_id").select("channel", column).distinct()
        counted = pairs.groupBy("channel").agg(F.count(F.lit(1)).alias(name))
        result = _join_null_safe(result, counted, ["channel"]).withColumn(name, F.coalesce(name, F.lit(0)))
    return result
