"""Warehouse tables: one Parquet folder per table below a root path, or catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MART_PREFIX = "mart_"

# Layout of the two fact tables; both columns have a bounded number of values (months, days).
PARTITION_COLUMNS = {"transactions": "month", "events": "date"}


def write_table(df: DataFrame, root: str, name: str, partition_by: str | None = None) -> str:
    """Replace table `name` below `root`.

    A partitioned table is rebalanced on its partition column first: few files per partition, and
    the adaptive planner splits a partition that holds far more rows than the others.
    """
    path = f"{root.rstrip('/')}/{name}"
    if partition_by:
        df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def write_mart(df: DataFrame, root: str, name: str) -> str:
    return write_table(df, root, MART_PREFIX + name)


def scan_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Lazy scan: readers get the columns they select, never the whole table."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def save_as_catalog_table(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """The same for a session with a catalog: replace table `name` there."""
    writer = (df.hint("rebalance", partition_by) if partition_by else df).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
