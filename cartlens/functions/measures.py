"""Reusable measures over the transaction fact: one aggregate each, valid under any grouping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartlens.functions.columns import mean, ratio, total


def total_revenue() -> Column:
    return total("net_revenue")


def total_orders() -> Column:
    return F.count(F.lit(1))


def average_order_value() -> Column:
    return mean("net_revenue")


def refund_rate() -> Column:
    return ratio(F.count_if("refund_flag"), F.count(F.lit(1)))


def conversion_rate() -> Column:
    """Orders per distinct buyer; a null customer counts as one buyer, as a BI distinct count does."""
    buyers = F.countDistinct("customer_id") + F.max(F.col("customer_id").isNull().cast("int"))
    return ratio(F.count(F.lit(1)), buyers)
