"""A warehouse that is brought up to date by what changed, and published whole or not at all.

Every table has a fingerprint per partition (transactions by month, events by day, the others whole). Against those
of the current generation they tell which partitions were added, rewritten or removed; only these are written.
The folds of the facts (per customer, campaign, product, day) are stored tables. Of them the keys that stand in a
changed partition, before or after, are folded anew from all their rows (a semi-join); the others are taken over
(an anti-join). Where these are most of the keys, all rows are folded without a look-up. The marts are derived from the folds: what depends on all customers (scores, medians) moves with
them, and no fact is read for it. A table whose content is the same keeps its folder.

The result equals a full build of the same raw tables. Readers hold the generation they opened.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.plans import marts
from cartlens.plans.clean import clean_all
from cartlens.plans.warehouse import Warehouse, side_by_side
from cartlens.sources import generations
from cartlens.sources.csv import scan_all_csv
from cartlens.sources.generations import changed_parts, fingerprints, manifest, scan_parts, write_parts
from cartlens.sources.stage import stage
from cartlens.sources.tables import MART_PREFIX, PARTITION_COLUMNS

# Stored folds: how they are made, of which fact, by which key.
FOLDS: dict[str, tuple[Callable[[DataFrame], DataFrame], str, str]] = {
    "fold_customer_purchases": (marts.customer_purchases, "transactions", "customer_id"),
    "fold_customer_events": (marts.customer_event_agg, "events", "customer_id"),
    "fold_campaign_purchases": (marts.campaign_tx_agg, "transactions", "campaign_id"),
    "fold_campaign_events": (marts.campaign_event_agg, "events", "campaign_id"),
    "fold_product_purchases": (marts.product_tx_agg, "transactions", "product_id"),
    "fold_daily_events": (marts.daily_event_counts, "events", "date"),
}
MARTS: dict[str, Callable[[Callable[[str], DataFrame]], DataFrame]] = {
    "customer_360": lambda t: marts.customer_360_of(
        t("customers"), marts.scored_purchases(t("fold_customer_purchases")), t("fold_customer_events")
    ),
    "campaign_performance": lambda t: marts.campaign_performance_of(
        t("campaigns"), t("fold_campaign_purchases"), t("fold_campaign_events")
    ),
    "funnel": lambda t: marts.funnel_of(t("fold_daily_events")),
    "product_performance": lambda t: marts.product_performance_of(t("products"), t("fold_product_purchases")),
}


def layout(df: DataFrame) -> str:
    """Names and types of the columns; what may be null depends on the plan alone."""
    return T.StructType([T.StructField(field.name, field.dataType) for field in df.schema]).json()


CHANGES = "table_name string, part string, change string"


class Publication:
    """One run: the generation before it and the manifest rows of the one it makes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.before = manifest(spark, root)
        # One row per partition, as the planner itself lists them.
        self.old_rows = [row.asDict() for row in self.before.collect()]
        self.rows: dict[str, list[dict]] = {}
        self.changes: list[dict] = []

    def old(self, table: str) -> list[dict]:
        return [row for row in self.old_rows if row["table_name"] == table]

    def old_table(self, table: str) -> DataFrame:
        return scan_parts(self.spark, self.root, table, self.old(table))

    def table(self, table: str) -> DataFrame:
        return scan_parts(self.spark, self.root, table, self.rows[table])

    def parts_of(self, table: str, parts: list) -> DataFrame:
        """Some partitions of a table alone: no other folder is opened."""
        rows = self.rows[table]
        return scan_parts(self.spark, self.root, table, [row for row in rows if row["part"] in parts] or [rows[0] | {"folder": None}])

    def changed(self, table: str) -> list[dict]:
        return [change for change in self.changes if change["table_name"] == table]

    def add(self, table: str, df: DataFrame, by: str | None = None, parts: list | None = None) -> None:
        """Write the partitions of `df` that differ from the former generation's.

        With `parts`, `df` holds these partitions alone, and the others are taken over unread."""
        by, schema = by or PARTITION_COLUMNS.get(table), layout(df)
        # A new layout of a table is a new table.
        old = [row for row in self.old(table) if row["table_schema"] == schema]
        carried = [] if parts is None else [row for row in old if row["part"] not in parts and row["row_count"]]
        old = old if parts is None else [row for row in old if row["part"] in parts]
        was = self.spark.createDataFrame(old, generations.MANIFEST)
        folders = {row["part"]: row["folder"] for row in old}
        if old:
            found = stage(fingerprints(df, table, by), "fingerprints")
        else:
            # Nothing to compare with: `df` is computed once, and what was written of it is read.
            folders = write_parts(df, self.root, table, by)
            places = [dict(folder=folder, table_schema=schema) for folder in folders.values()]
            written_df = scan_parts(self.spark, self.root, table, places or [dict(folder=None, table_schema=schema)])
            found = stage(fingerprints(written_df, table, by), "fingerprints")
        changes = [row.asDict() for row in changed_parts(was, found).collect()]
        written = [change["part"] for change in changes if change["change"] != "removed"]
        if old and written:
            touched = df
            if by and len(written) < found.count():
                parts = self.spark.createDataFrame([(part,) for part in written], "part string")
                touched = df.join(parts, F.col(by).cast("string").eqNullSafe(parts["part"]), "left_semi")
            folders |= write_parts(touched, self.root, table, by)
        # An empty table has no partition, and a row of its own for its schema.
        rows = [row.asDict() for row in found.collect()]
        rows = rows or ([] if carried else [dict(table_name=table, part=None, row_count=0, content=None)])
        self.rows[table] = carried + [row | {"folder": folders.get(row["part"]) if row["row_count"] else None, "table_schema": schema} for row in rows]
        self.changes += changes

    def add_derived(self, name: str, df: DataFrame, by: str | None = None, parts: list | None = None) -> None:
        """The same of a result that costs more to compute than to write: once, also where it is compared."""
        self.add(name, stage(df, name) if self.old(name) else df, by, parts)

    def fold(self, name: str) -> None:
        """Fold the keys of changed partitions anew and take over the others."""
        function, fact, key = FOLDS[name]
        now, changed = self.table(fact), [change["part"] for change in self.changed(fact)]
        old = self.old(name)
        if not old or old[0]["table_schema"] != layout(function(now)):
            self.add_derived(name, function(now))
            return
        if not changed:
            self.rows[name] = old
            return
        by = PARTITION_COLUMNS[fact]
        parts = self.spark.createDataFrame([(part,) for part in changed], "part string")

        def keys_of(df: DataFrame) -> DataFrame:
            return df.join(parts, F.col(by).cast("string").eqNullSafe(parts["part"]), "left_semi").select(F.col(key).alias("touched"))

        touched = stage(keys_of(now).union(keys_of(self.old_table(fact))).distinct(), "touched-keys")
        if 2 * touched.count() > sum(row["row_count"] for row in old):
            # Most keys: all rows are folded, none is looked up before.
            self.add_derived(name, function(now))
            return

        def among(df: DataFrame, kind: str) -> DataFrame:
            return df.join(touched, df[key].eqNullSafe(touched["touched"]), kind)

        kept = among(self.old_table(name), "left_anti")
        self.add_derived(name, kept.unionByName(function(among(now, "left_semi"))))

    def mart(self, name: str) -> None:
        self.add_derived(MART_PREFIX + name, MARTS[name](self.table))

    def manifest_rows(self) -> DataFrame:
        columns = [column.split()[0] for column in generations.MANIFEST.split(", ")]
        rows = [tuple(row[c] for c in columns) for found in self.rows.values() for row in found]
        return self.spark.createDataFrame(rows, generations.MANIFEST)


def publish_warehouse(
    spark: SparkSession,
    source: str | dict[str, DataFrame],
    root: str,
    multi_line: bool = False,
    more: Callable[[Publication], None] | None = None,
) -> DataFrame:
    """Bring the warehouse below `root` up to date with the raw tables (a folder of CSV files, or frames), and publish it.

    table_name, part and change of every partition that was written or went. Nothing is published where nothing
    changed. `more` may add tables to the same generation (`plans.spans.keep_spans`)."""
    raw = scan_all_csv(spark, source, multi_line) if isinstance(source, str) else source

    def derive(run: Publication) -> None:
        side_by_side([partial(run.fold, name) for name in FOLDS])
        side_by_side([partial(run.mart, name) for name in MARTS])
        if more:
            more(run)

    return publish_tables(spark, root, clean_all(raw), derive)


def publish_tables(
    spark: SparkSession, root: str, tables: dict[str, DataFrame], derive: Callable[[Publication], None]
) -> DataFrame:
    """Publish tables and what `derive` adds to the run from them, as one generation."""
    run = Publication(spark, root)
    side_by_side([partial(run.add, name, df) for name, df in tables.items()])
    derive(run)
    changes = spark.createDataFrame([(c["table_name"], c["part"], c["change"]) for c in run.changes], CHANGES)
    if run.changes or not run.old_rows:
        generations.publish(spark, root, run.manifest_rows())
    return changes


def open_published(spark: SparkSession, root: str, generation: int | None = None) -> Warehouse:
    """The current generation, or an earlier one; it stays the same while others are published."""
    rows = [row.asDict() for row in manifest(spark, root, generation).collect()]
    if not rows:
        raise ValueError(f"nothing was published below {root}")

    def opened(_: Warehouse, name: str) -> DataFrame:
        return scan_parts(spark, root, name, [row for row in rows if row["table_name"] == name])

    return Warehouse(spark, opened)
