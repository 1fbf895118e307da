"""Columns of the five raw tables, as they arrive: all text, typed by the cleaners."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of the input files.
RAW_COLUMNS = {
    "campaigns": [
        "campaign_id", "channel", "objective", "start_date", "end_date", "target_segment", "expected_uplift",
    ],
    "customers": [
        "customer_id", "signup_date", "country", "age", "gender", "loyalty_tier", "acquisition_channel",
    ],
    "events": [
        "event_id", "timestamp", "customer_id", "session_id", "event_type", "product_id", "device_type",
        "traffic_source", "campaign_id", "page_category", "session_duration_sec", "experiment_group",
    ],
    "products": ["product_id", "category", "brand", "base_price", "launch_date", "is_premium"],
    "transactions": [
        "transaction_id", "timestamp", "customer_id", "product_id", "quantity", "discount_applied",
        "gross_revenue", "campaign_id", "refund_flag",
    ],
}


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in columns])
