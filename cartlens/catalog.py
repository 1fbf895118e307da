"""Every operator and report by name: a function from a warehouse to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.functions.columns import ratio, round_half_even
from cartlens.operators.date_spelling import spelling_orders
from cartlens.operators.profile import profile_all, row_sums_all, table_sizes, value_sums_all
from cartlens.plans import (
    behaviour,
    campaigns,
    charts,
    customers,
    eda,
    marts,
    revenue,
    spans,
    sql_reports,
    star,
    workbook,
)
from cartlens.plans.clean import CLEANERS, clean_transactions
from cartlens.plans.publish import CHANGES, Publication, open_published, publish_warehouse
from cartlens.plans.warehouse import Warehouse, build_warehouse
from cartlens.sources.csv import differing_csv, read_text, scan_csv, write_all_csv, write_csv
from cartlens.sources.generations import publish
from cartlens.sources.schemas import RAW_COLUMNS
from cartlens.sources.stage import new_folder, stage
from cartlens.sources.tables import MART_PREFIX, PARTITION_COLUMNS, scan_table, write_mart, write_table

Report = Callable[[Warehouse], DataFrame]


# --- sources and sinks: written to a fresh folder and read back --------------------------------


def csv_round_trip(w: Warehouse) -> DataFrame:
    """Transactions written as CSV text, scanned with the null rules and cleaned."""
    path = new_folder(w.spark, "transactions.csv")
    write_csv(w.raw["transactions"], path)
    return clean_transactions(scan_csv(w.spark, path, RAW_COLUMNS["transactions"]))


def csv_line_breaks(w: Warehouse) -> DataFrame:
    """The same with quotes, commas and line breaks in every transaction's id, read by byte ranges."""
    path = new_folder(w.spark, "line-breaks.csv")
    broken = F.concat("transaction_id", F.lit('\n"'), F.col("product_id").cast("string"), F.lit('",\n,'))
    write_csv(w.raw["transactions"].withColumn("transaction_id", broken), path)
    return clean_transactions(scan_csv(w.spark, path, RAW_COLUMNS["transactions"], multi_line=True))


# Spellings of a time of day on a date, one for each remainder of the product's number.
SPELLINGS = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "M.d.yyyy hh:mm:ss a", "d MMMM yyyy HH:mm:ss"]


def mixed_spellings(w: Warehouse) -> DataFrame:
    """Raw transactions with their time as text in four spellings."""
    no = F.col("product_id") % len(SPELLINGS)
    spelled = [F.when(no == key, F.date_format("timestamp", form)) for key, form in enumerate(SPELLINGS)]
    return w.raw["transactions"].withColumn("timestamp", F.coalesce(*spelled))


def clean_mixed_spellings(w: Warehouse) -> DataFrame:
    return clean_transactions(mixed_spellings(w))


def date_orders(w: Warehouse) -> DataFrame:
    return spelling_orders(mixed_spellings(w), "timestamp")


def ingest_rowcount(w: Warehouse) -> DataFrame:
    return table_sizes(w.raw)


def profile_raw(w: Warehouse) -> DataFrame:
    return profile_all(w.raw).select("table_name", "column_name", "column_type", "null_count")


def table_round_trip(w: Warehouse) -> DataFrame:
    root = new_folder(w.spark, "tables")
    write_table(w.transactions, root, "transactions", "month")
    return scan_table(w.spark, root, "transactions").select(w.transactions.columns)


def mart_round_trip(w: Warehouse) -> DataFrame:
    root = new_folder(w.spark, "tables")
    write_mart(w.product_performance, root, "product_performance")
    return scan_table(w.spark, root, MART_PREFIX + "product_performance")


def scan_events(w: Warehouse) -> DataFrame:
    """Events written by day and scanned again."""
    root = new_folder(w.spark, "tables")
    write_table(w.events, root, "events", "date")
    return scan_table(w.spark, root, "events").select(w.events.columns)


def loaded_counts(w: Warehouse) -> DataFrame:
    """Rows of every cleaned table and mart after a load."""
    named = w.cleaned() | {MART_PREFIX + name: df for name, df in w.marts().items()}
    return table_sizes(named).select("table_name", "row_count")


def star_csv_values(w: Warehouse) -> DataFrame:
    """The nine exports written as CSV; sums over every column of what is read back."""
    return _read_back(w, write_all_csv(star.exports(w), new_folder(w.spark, "star")))


def star_csv_rows(w: Warehouse) -> DataFrame:
    """The same exports; sums of the digests of the rows that are read back."""
    paths = write_all_csv(star.exports(w), new_folder(w.spark, "star"))
    return row_sums_all({name: read_text(w.spark, path) for name, path in paths.items()}, by_value=True)


def star_csv_differing(w: Warehouse) -> DataFrame:
    """Exports whose files differ from what was to be written."""
    exports = star.exports(w)
    return differing_csv(exports, write_all_csv(exports, new_folder(w.spark, "star")))


def report_table_values(w: Warehouse) -> DataFrame:
    return _read_back(w, workbook.write_report_tables(w, new_folder(w.spark, "report-tables")))


def _read_back(w: Warehouse, paths: dict[str, str]) -> DataFrame:
    def text(path: str) -> DataFrame:
        return w.spark.read.option("header", True).option("escape", '"').csv(path)

    return value_sums_all({name: text(path) for name, path in paths.items()})


def full_build(w: Warehouse) -> DataFrame:
    """Raw tables to a complete warehouse on disk; sums over every column of its tables."""
    built = build_warehouse(w.spark, w.raw, new_folder(w.spark, "warehouse"))
    tables = built.cleaned() | {MART_PREFIX + name: df for name, df in built.marts().items()}
    return value_sums_all(tables)


def _earlier(w: Warehouse) -> dict[str, DataFrame]:
    """The raw tables as they may have been before: without the events of the last day, the transactions of the
    last month and, of the first month, those of every second customer."""
    time = F.col("timestamp")
    ends = w.raw["transactions"].agg(F.struct(F.min(time).alias("first"), F.max(time).alias("last"))).scalar()
    month = F.date_trunc("month", time)
    sales = w.raw["transactions"].withColumn("ends", ends)
    sales = sales.where(month < F.date_trunc("month", F.col("ends.last")))
    sales = sales.where((month > F.date_trunc("month", F.col("ends.first"))) | (F.col("customer_id") % 2 == 0))
    last_day = w.raw["events"].agg(F.to_date(F.max(time))).scalar()
    events = w.raw["events"].withColumn("ends", last_day).where(F.to_date(time) < F.col("ends"))
    return w.raw | {"transactions": sales.drop("ends"), "events": events.drop("ends")}


def _raw_once(w: Warehouse) -> Warehouse:
    """The same raw tables, the joined ones written down: an update reads them several times."""
    joined = {name: stage(w.raw[name], f"raw-{name}") for name in ("customers", "transactions")}
    return Warehouse(w.spark, w.table, w.raw | joined)


def refreshed_build(w: Warehouse) -> DataFrame:
    """An earlier state published, then brought up to date; sums over every column, equal to a full build's."""
    w = _raw_once(w)
    root = new_folder(w.spark, "published")
    publish_warehouse(w.spark, _earlier(w), root)
    publish_warehouse(w.spark, w.raw, root)
    built = open_published(w.spark, root)
    tables = built.cleaned() | {MART_PREFIX + name: df for name, df in built.marts().items()}
    return value_sums_all(tables)


def refreshed_partitions(w: Warehouse) -> DataFrame:
    """The partitions of the facts that such an update writes."""
    w = _raw_once(w)
    root = new_folder(w.spark, "published")
    for raw in (_earlier(w), w.raw):
        run = Publication(w.spark, root)
        for name in PARTITION_COLUMNS:
            run.add(name, CLEANERS[name](raw[name]))
        publish(w.spark, root, run.manifest_rows())
    return w.spark.createDataFrame([(c["table_name"], c["part"], c["change"]) for c in run.changes], CHANGES)


def null_report(w: Warehouse) -> DataFrame:
    """Cleaned tables: row count and the columns that hold nulls."""
    return (
        profile_all(w.cleaned())
        .where(F.col("null_count") > 0)
        .select("table_name", "row_count", "column_name", "null_count")
    )


SOURCES: dict[str, Report] = {
    "scan_csv": csv_round_trip,
    "scan_csv_line_breaks": csv_line_breaks,
    "ingest_rowcount": ingest_rowcount,
    "profile_raw": profile_raw,
    "write_table": table_round_trip,
    "write_mart": mart_round_trip,
    "post_load_count": loaded_counts,
    "scan_table": scan_events,
    "write_csv_star": star_csv_values,
    "write_csv_star_rows": star_csv_rows,
    "write_csv_star_differing": star_csv_differing,
    "report_tables": report_table_values,
    "build_warehouse": full_build,
    "publish_warehouse": refreshed_build,
    "publish_changes": refreshed_partitions,
}

CLEANING: dict[str, Report] = {
    "clean_campaigns": lambda w: w.campaigns,
    "clean_customers": lambda w: w.customers,
    "clean_events": lambda w: w.events,
    "clean_products": lambda w: w.products,
    "clean_transactions": lambda w: w.transactions,
    "clean_date_spellings": clean_mixed_spellings,
    "date_orders": date_orders,
    "clean_all_null_report": null_report,
}


# --- marts and their steps, computed from the cleaned tables ------------------------------------


def staged_purchases(w: Warehouse) -> DataFrame:
    return stage(marts.customer_purchases(w.transactions), "customer-purchases")


def customer_conversion(w: Warehouse) -> DataFrame:
    return marts.customer_event_agg(w.events).select(
        "customer_id", "purchase_events", "total_sessions", "conversion_rate"
    )


def rfm_scores(w: Warehouse) -> DataFrame:
    return marts.scored_customers(w.transactions).select(
        "customer_id", "recency_days", "total_orders", "total_revenue", "r_score", "f_score", "m_score", "rfm_score"
    )


def campaign_roi(w: Warehouse) -> DataFrame:
    perf = w.campaign_performance
    return perf.select("campaign_id", "net_revenue", marts.against_median(perf).alias("roi"))


def revenue_per_visitor(w: Warehouse) -> DataFrame:
    net = marts.campaign_tx_agg(w.transactions).select("campaign_id", "net_revenue")
    visitors = (
        w.events.where(F.col("campaign_id").isNotNull())
        .groupBy("campaign_id")
        .agg(F.countDistinct("customer_id").alias("unique_visitors"))
    )
    return (
        w.campaigns.select("campaign_id")
        .join(net, "campaign_id", "left")
        .join(visitors, "campaign_id", "left")
        .select(
            "campaign_id",
            "net_revenue",
            "unique_visitors",
            round_half_even(ratio("net_revenue", "unique_visitors"), 2).alias("revenue_per_visitor"),
        )
    )


def built_marts(w: Warehouse) -> DataFrame:
    """All four marts built from the cleaned tables and written; sums over every column of each."""
    built = {MART_PREFIX + name: df for name, df in marts.build_all(w.cleaned()).items()}
    return value_sums_all({name: stage(df, name) for name, df in built.items()})


MART_STEPS: dict[str, Report] = {
    "customer_tx_agg": lambda w: marts.customer_tx_agg(marts.customer_purchases(w.transactions)),
    "recency_lifetime": lambda w: marts.recency_lifetime(staged_purchases(w)).select(
        "customer_id", "first_purchase", "last_purchase", "recency_days", "customer_lifetime_days"
    ),
    "rfm_scores": rfm_scores,
    "rfm_segment": lambda w: marts.scored_customers(w.transactions).select("customer_id", "rfm_score", "rfm_segment"),
    "customer_event_agg": lambda w: marts.customer_event_agg(w.events).drop("conversion_rate"),
    "customer_conversion": customer_conversion,
    "customer_360": lambda w: marts.customer_360(w.customers, w.transactions, w.events),
    "campaign_tx_agg": lambda w: marts.campaign_tx_agg(w.transactions),
    "campaign_event_agg": lambda w: marts.campaign_event_agg(w.events),
    "campaign_rates": lambda w: marts.campaign_rates(marts.campaign_event_agg(w.events)).select(
        "campaign_id", "bounce_rate", "click_to_cart_rate", "conversion_rate"
    ),
    "campaign_performance": lambda w: marts.campaign_performance(w.campaigns, w.transactions, w.events),
    "campaign_roi": campaign_roi,
    "revenue_per_visitor": revenue_per_visitor,
    "funnel": lambda w: marts.funnel(w.events),
    "product_performance": lambda w: marts.product_performance(w.products, w.transactions),
    "build_all": built_marts,
}

# --- spans of days, answered from what an updated publication keeps per day ----------------------


_span_roots: WeakKeyDictionary[Warehouse, str] = WeakKeyDictionary()


def _span(answer: Callable[[spans.Spans], DataFrame]) -> Report:
    """Answered from the second generation; a warehouse's events are published once for all of these."""

    def report(w: Warehouse) -> DataFrame:
        if w not in _span_roots:
            root = new_folder(w.spark, "spans")
            spans.publish_twice(w, root)
            _span_roots[w] = root
        return answer(spans.Spans(w.spark, _span_roots[w]))

    return report


SPANS: dict[str, Report] = {
    "span_customer_events": _span(lambda s: s.customers(*s.last_days(spans.SPAN_DAYS))),
    "span_campaign_events": _span(lambda s: s.campaigns(*s.last_days(spans.SPAN_DAYS))),
    "span_ab_groups": _span(lambda s: s.groups(*s.last_days(spans.SPAN_DAYS))),
    "span_whole_customer_events": _span(lambda s: s.customers()),
}

# Answered from the raw tables, which a warehouse opened from disk does not have.
NEEDS_RAW = (
    "scan_csv", "scan_csv_line_breaks", "ingest_rowcount", "profile_raw", "build_warehouse", "publish_warehouse",
    "publish_changes", "clean_date_spellings", "date_orders",
)

CATALOG: dict[str, Report] = {
    **SOURCES,
    **CLEANING,
    **MART_STEPS,
    **SPANS,
    **sql_reports.REPORTS,
    **eda.REPORTS,
    **customers.REPORTS,
    **campaigns.REPORTS,
    **revenue.REPORTS,
    **behaviour.REPORTS,
    **workbook.REPORTS,
    **star.REPORTS,
    **charts.REPORTS,
}

