"""Building the warehouse and reading from it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession

from cartlens.plans import marts
from cartlens.plans.clean import CLEANERS, clean_all
from cartlens.sources.csv import scan_all_csv
from cartlens.sources.jobs import side_by_side
from cartlens.sources.stage import stage
from cartlens.sources.tables import (
    MART_PREFIX,
    PARTITION_COLUMNS,
    save_as_catalog_table,
    scan_table,
    write_mart,
    write_table,
)

# Each mart's builder and the cleaned tables it reads.
MARTS = {
    "customer_360": (marts.customer_360, ["customers", "transactions", "events"]),
    "campaign_performance": (marts.campaign_performance, ["campaigns", "transactions", "events"]),
    "funnel": (marts.funnel, ["events"]),
    "product_performance": (marts.product_performance, ["products", "transactions"]),
}


class Warehouse:
    """Cleaned tables and marts by name, each opened on first use."""

    def __init__(
        self,
        spark: SparkSession,
        opener: Callable[["Warehouse", str], DataFrame],
        raw: dict[str, DataFrame] | None = None,
    ):
        self.spark = spark
        self.raw = raw or {}
        self._opener = opener

    def _open(self, name: str) -> DataFrame:
        return self._opener(self, name)

    def table(self, name: str) -> DataFrame:
        """Any stored table by its name."""
        return self._open(name)

    @cached_property
    def campaigns(self) -> DataFrame:
        return self._open("campaigns")

    @cached_property
    def customers(self) -> DataFrame:
        return self._open("customers")

    @cached_property
    def events(self) -> DataFrame:
        return self._open("events")

    @cached_property
    def products(self) -> DataFrame:
        return self._open("products")

    @cached_property
    def transactions(self) -> DataFrame:
        return self._open("transactions")

    @cached_property
    def customer_360(self) -> DataFrame:
        return self._open("mart_customer_360")

    @cached_property
    def campaign_performance(self) -> DataFrame:
        return self._open("mart_campaign_performance")

    @cached_property
    def funnel(self) -> DataFrame:
        return self._open("mart_funnel")

    @cached_property
    def product_performance(self) -> DataFrame:
        return self._open("mart_product_performance")

    def cleaned(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in CLEANERS}

    def marts(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in MARTS}


def open_warehouse(spark: SparkSession, root: str) -> Warehouse:
    """A warehouse that was built before."""
    return Warehouse(spark, lambda _, name: scan_table(spark, root, name))


def register_views(warehouse: Warehouse) -> list[str]:
    """The cleaned tables and marts as temporary views of the session, for SQL; their names."""
    tables = warehouse.cleaned() | {MART_PREFIX + name: df for name, df in warehouse.marts().items()}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return list(tables)


def save_in_catalog(warehouse: Warehouse) -> list[str]:
    """The same as tables of the session's catalog."""
    tables = warehouse.cleaned() | {MART_PREFIX + name: df for name, df in warehouse.marts().items()}
    for name, df in tables.items():
        save_as_catalog_table(df, name, PARTITION_COLUMNS.get(name))
    return list(tables)


def staged_warehouse(spark: SparkSession, raw: dict[str, DataFrame]) -> Warehouse:
    """A warehouse over raw frames that writes each table or mart only when it is first read."""

    def build(warehouse: Warehouse, name: str) -> DataFrame:
        if name in CLEANERS:
            return stage(CLEANERS[name](raw[name]), name)
        builder, inputs = MARTS[name.removeprefix(MART_PREFIX)]
        return stage(builder(*[getattr(warehouse, table) for table in inputs]), name)

    return Warehouse(spark, build, raw)


def build_warehouse(
    spark: SparkSession,
    source: str | dict[str, DataFrame],
    root: str,
    partition_by: dict[str, str] = PARTITION_COLUMNS,
    multi_line: bool = False,
) -> Warehouse:
    """Rebuild everything: raw tables (a folder of CSV files, or frames) -> cleaned tables -> marts.

    The marts read the cleaned tables back from where they were written, so each fact is parsed once.
    Tables, and then marts, do not depend on each other: their jobs are submitted side by side, and
    the small ones fill the gaps the large ones leave on the cluster.
    """
    raw = scan_all_csv(spark, source, multi_line) if isinstance(source, str) else source
    side_by_side(
        [partial(write_table, df, root, name, partition_by.get(name)) for name, df in clean_all(raw).items()]
    )
    warehouse = open_warehouse(spark, root)

    def build_mart(name: str) -> None:
        builder, inputs = MARTS[name]
        write_mart(builder(*[scan_table(spark, root, table) for table in inputs]), root, name)

    side_by_side([partial(build_mart, name) for name in MARTS])
    return warehouse
