"""Typing and cleaning of the five raw tables.

Every cleaner is one projection over its input, so it runs inside the scan's stage and columns a
reader does not ask for are never parsed. Inputs may be text (CSV) or already typed (Parquet). A date column of
text is read once before, to tell day-first from month-first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.functions.columns import EXACT, MONEY, month_of, trimmed, weekday_name
from cartlens.operators.date_spelling import read_time
from cartlens.vocabulary import LOYALTY_TIERS, NO_CAMPAIGN


def clean_campaigns(raw: DataFrame) -> DataFrame:
    typed = raw.withColumns(
        {
            "campaign_id": _whole_number(raw, "campaign_id"),
            "channel": trimmed("channel"),
            "objective": trimmed("objective"),
            "target_segment": trimmed("target_segment"),
            "start_date": read_time(raw, "start_date", "date"),
            "end_date": read_time(raw, "end_date", "date"),
            "expected_uplift": F.col("expected_uplift").cast("double"),
        }
    )
    return typed.withColumn("duration_days", F.datediff("end_date", "start_date"))


def clean_customers(raw: DataFrame) -> DataFrame:
    tier = F.col("loyalty_tier")
    return raw.withColumns(
        {
            "customer_id": _whole_number(raw, "customer_id"),
            "signup_date": read_time(raw, "signup_date", "date"),
            "country": F.upper(trimmed("country")),
            "age": F.col("age").try_cast("double"),
            "gender": trimmed("gender"),
            "loyalty_tier": F.when(tier.isin(LOYALTY_TIERS), tier),
            "acquisition_channel": trimmed("acquisition_channel"),
        }
    )


def clean_events(raw: DataFrame) -> DataFrame:
    typed = raw.withColumns(
        {
            "timestamp": read_time(raw, "timestamp", "timestamp_ntz"),
            "customer_id": _whole_number(raw, "customer_id"),
            "event_type": trimmed("event_type"),
            "product_id": _whole_number_or_null(raw, "product_id"),
            "device_type": trimmed("device_type"),
            "traffic_source": trimmed("traffic_source"),
            "campaign_id": F.coalesce(_whole_number(raw, "campaign_id"), F.lit(NO_CAMPAIGN).cast("bigint")),
            "page_category": trimmed("page_category"),
            "session_duration_sec": F.col("session_duration_sec").cast(EXACT),
            "experiment_group": trimmed("experiment_group"),
        }
    )
    return typed.withColumns(
        {
            "date": F.to_date("timestamp"),
            "hour": F.hour("timestamp"),
            "day_of_week": weekday_name("timestamp"),
        }
    )


def clean_products(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "product_id": _whole_number(raw, "product_id"),
            "category": trimmed("category"),
            "brand": trimmed("brand"),
            "base_price": F.col("base_price").try_cast(MONEY),
            "launch_date": read_time(raw, "launch_date", "date"),
            "is_premium": _flag(raw, "is_premium"),
        }
    )


def clean_transactions(raw: DataFrame) -> DataFrame:
    typed = raw.withColumns(
        {
            "timestamp": read_time(raw, "timestamp", "timestamp_ntz"),
            "customer_id": _whole_number(raw, "customer_id"),
            "product_id": _whole_number_or_null(raw, "product_id"),
            "quantity": _whole_number(raw, "quantity").cast("int"),
            "discount_applied": F.coalesce(F.col("discount_applied").try_cast(EXACT), F.lit(0).cast(EXACT)),
            "gross_revenue": F.col("gross_revenue").try_cast(MONEY),
            "campaign_id": F.coalesce(_whole_number(raw, "campaign_id"), F.lit(NO_CAMPAIGN).cast("bigint")),
            "refund_flag": _flag(raw, "refund_flag"),
        }
    )
    return typed.withColumns(
        {
            "date": F.to_date("timestamp"),
            "month": month_of("timestamp"),
            "year": F.year("timestamp"),
            "net_revenue": F.when(F.col("refund_flag"), F.lit(0).cast(MONEY)).otherwise(F.col("gross_revenue")),
        }
    )


CLEANERS = {
    "campaigns": clean_campaigns,
    "customers": clean_customers,
    "events": clean_events,
    "products": clean_products,
    "transactions": clean_transactions,
}


def clean_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: cleaner(raw[name]) for name, cleaner in CLEANERS.items()}


def _whole_number(raw: DataFrame, name: str) -> Column:
    """BIGINT; '12' and '12.0' both read as 12, other text is an error."""
    return _whole(raw, name, F.col(name).cast("decimal(38,6)").cast("bigint"))


def _whole_number_or_null(raw: DataFrame, name: str) -> Column:
    """BIGINT, null for text that is no number."""
    return _whole(raw, name, F.col(name).try_cast("decimal(38,6)").cast("bigint"))


def _whole(raw: DataFrame, name: str, by_decimal: Column) -> Column:
    """BIGINT; `by_decimal` for what is not a plain whole number already, as most are: a decimal costs many times more."""
    column, kind = F.col(name), raw.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return column.cast("bigint")
    whole = column.try_cast("bigint")
    if isinstance(kind, T.StringType):
        return F.when(whole.cast("string") == column, whole).otherwise(by_decimal)
    if isinstance(kind, T.DoubleType):
        # Up to 1e15 the shortest text of a whole double, which a decimal is read from, is its exact value.
        return F.when((whole.cast("double") == column) & (F.abs(column) < 1e15), whole).otherwise(by_decimal)
    return by_decimal


def _flag(raw: DataFrame, name: str) -> Column:
    """BOOLEAN from 0/1, true/false or a number; a missing or unreadable flag counts as true."""
    column = F.col(name)
    kind = raw.schema[name].dataType
    if isinstance(kind, T.StringType):
        parsed = F.coalesce(column.try_cast("boolean"), column.try_cast("double") != 0)
    elif isinstance(kind, T.BooleanType):
        parsed = column
    else:
        parsed = column != 0
    return F.coalesce(parsed, F.lit(True))
