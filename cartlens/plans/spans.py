"""Event figures of any span of days, distinct counts included, from what is kept per day.

Per grain (customer, campaign, experiment group) and day there are stored sums, and per counted id the bit words of
`operators.distinct_bits`. A span of days merges the days' rows; no event is read. The tables belong to a publication
and are partitioned by day: an update reads the events of changed days, rewrites the words and sums of those days and
carries the other days over by name. The dictionaries only grow: ids that are new get the next numbers, as a batch
of their own, so no word of another day changes its meaning. Ids that no event has any more keep their numbers.

Events without a time belong to no day: they count where a span has neither end, as in the full folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.functions.columns import ratio, round_half_even, round_half_up
from cartlens.operators.distinct_bits import bit_words, count_bits, number_ids
from cartlens.plans.publish import Publication, open_published, publish_tables
from cartlens.plans.warehouse import Warehouse, side_by_side
from cartlens.sources import generations

DAY = "date"
# The ids that are counted, and what else orders their numbers: a customer's sessions stand side by side.
IDS: dict[str, str | None] = {"customer_id": None, "session_id": "customer_id", "device_type": None}
# Grain: what is counted for it.
GRAINS: dict[str, list[str]] = {
    "customer_id": ["session_id", "device_type"],
    "campaign_id": ["customer_id"],
    "experiment_group": ["session_id", "customer_id"],
}
KINDS = {"purchases": "purchase", "bounces": "bounce", "add_to_carts": "add_to_cart"}
EVENTS = "events"


def ids_table(column: str) -> str:
    return f"span_ids_{column}"


def sums_table(grain: str) -> str:
    return f"span_sums_{grain}"


def bits_table(grain: str, column: str) -> str:
    return f"span_bits_{grain}_{column}"


def span_tables() -> list[str]:
    bits = [bits_table(grain, column) for grain, columns in GRAINS.items() for column in columns]
    return [*map(ids_table, IDS), *map(sums_table, GRAINS), *bits]


# --- keeping ------------------------------------------------------------------------------------


def keep_spans(run: Publication) -> None:
    """Bring the span tables of a publication up to date; its events are added before."""
    changed = [change["part"] for change in run.changed(EVENTS)]
    old, new = run.old(EVENTS), run.rows[EVENTS]
    fresh = not all(run.old(name) for name in span_tables()) or old[0]["table_schema"] != new[0]["table_schema"]
    if not fresh and not changed:
        run.rows |= {name: run.old(name) for name in span_tables()}
        return
    days = None if fresh else changed
    events = run.table(EVENTS) if fresh else run.parts_of(EVENTS, changed)
    side_by_side([partial(_add_ids, run, events, column, fresh) for column in IDS])
    jobs = [partial(_add_sums, run, events, grain, days) for grain in GRAINS]
    jobs += [partial(_add_bits, run, events, grain, column, days) for grain, columns in GRAINS.items() for column in columns]
    side_by_side(jobs)


def _add_ids(run: Publication, events: DataFrame, column: str, fresh: bool) -> None:
    """Number the ids that the dictionary does not hold yet."""
    name, beside = ids_table(column), IDS[column]
    found = events.where(F.col(column).isNotNull()).groupBy(column)
    found = found.agg(F.min(beside).alias("beside")) if beside else found.agg(F.lit(0).alias("beside"))
    first, batch, carried = 0, 0, []
    if not fresh:
        known = run.old_table(name)
        found = found.join(known.select(column), column, "left_anti")
        first, batch = known.agg(F.coalesce(F.max("number") + 1, F.lit(0)), F.coalesce(F.max("batch") + 1, F.lit(0))).first()
        carried = [str(batch)]
    numbered = number_ids(found, ["beside", column], first).select(column, "number", F.lit(batch).cast("int").alias("batch"))
    run.add_derived(name, numbered, "batch", None if fresh else carried)


def _add_sums(run: Publication, events: DataFrame, grain: str, days: list | None) -> None:
    """Per day and grain: events, kinds of events and the sum and number of durations."""
    kinds = [F.count_if(F.col("event_type") == kind).alias(name) for name, kind in KINDS.items()]
    seconds = F.col("session_duration_sec")
    sums = events.groupBy(grain, DAY).agg(
        F.count("event_id").alias("events"), *kinds, F.sum(seconds).alias("seconds"), F.count(seconds).alias("timed")
    )
    run.add_derived(sums_table(grain), sums, DAY, days)


def _add_bits(run: Publication, events: DataFrame, grain: str, column: str, days: list | None) -> None:
    name = bits_table(grain, column)
    run.add_derived(name, bit_words(events, [grain, DAY], column, run.table(ids_table(column))), DAY, days)


def publish_spans(spark: SparkSession, events: DataFrame, root: str) -> DataFrame:
    """Publish cleaned events and their span tables below `root`; what was written, as `publish_warehouse`."""
    return publish_tables(spark, root, {EVENTS: events}, keep_spans)


# --- answering ----------------------------------------------------------------------------------


class Spans:
    """The span tables of one generation and the figures of the days from `first` to `last`, both included; None is
    no end. Days are ISO text."""

    def __init__(self, spark: SparkSession, root: str, generation: int | None = None) -> None:
        self._tables: Warehouse = open_published(spark, root, generation)
        parts = generations.manifest(spark, root, generation).where((F.col("table_name") == EVENTS) & (F.col("row_count") > 0))
        self._last = parts.agg(F.max("part")).first()[0]

    def last_days(self, number: int) -> tuple[str | None, str | None]:
        """The span of the last `number` days up to the latest day with events."""
        if self._last is None:
            return None, None
        spark = self._tables.spark
        first = spark.range(1).select(F.date_sub(F.lit(self._last).cast("date"), number - 1).cast("string")).first()[0]
        return first, self._last

    def _between(self, table: str, first: str | None, last: str | None) -> DataFrame:
        df = self._tables.table(table)
        if first is not None:
            df = df.where(F.col(DAY) >= F.lit(first).cast("date"))
        return df if last is None else df.where(F.col(DAY) <= F.lit(last).cast("date"))

    def of(self, grain: str, names: dict[str, str], first: str | None = None, last: str | None = None, by: Sequence[str] = ()) -> DataFrame:
        """One row per value of `grain` that has an event in the span: events, kinds, mean_seconds, and for each
        `{output: column}` the number of distinct values. `by` may name the day, for one row per day beside."""
        keys = [grain, *by]
        sums = self._between(sums_table(grain), first, last).groupBy(*keys)
        mean = F.try_divide(F.sum("seconds").cast("double"), F.sum("timed").cast("double"))
        figures = sums.agg(*[F.sum(name).alias(name) for name in ("events", *KINDS)], mean.alias("mean_seconds"))
        for name, column in names.items():
            words = self._between(bits_table(grain, column), first, last)
            counted = count_bits(words, keys, name).withColumnsRenamed({key: f"__{key}" for key in keys})
            same = F.lit(True)
            for key in keys:
                same = same & F.col(key).eqNullSafe(F.col(f"__{key}"))
            figures = figures.join(counted, same, "left").drop(*[f"__{key}" for key in keys])
        return figures.withColumns({name: F.coalesce(name, F.lit(0)) for name in names})

    def customers(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The columns of `customer_event_agg`."""
        found = self.of("customer_id", {"total_sessions": "session_id", "devices_used": "device_type"}, first, last)
        return found.where(F.col("customer_id").isNotNull()).select(
            "customer_id", F.col("events").alias("total_events"), F.col("purchases").alias("purchase_events"),
            F.col("bounces").alias("bounce_events"), F.col("mean_seconds").alias("avg_session_duration"),
            "total_sessions", "devices_used",
            round_half_even(ratio("purchases", "total_sessions"), 4).alias("conversion_rate"),
        )

    def campaigns(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The columns of `campaign_event_agg`."""
        found = self.of("campaign_id", {"unique_visitors": "customer_id"}, first, last)
        return found.where(F.col("campaign_id").isNotNull()).select(
            "campaign_id", F.col("events").alias("impressions"), "purchases", "bounces", "add_to_carts",
            F.col("mean_seconds").alias("avg_session_sec"), "unique_visitors",
        )

    def groups(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The columns of the A/B report `q05_ab_groups`."""
        found = self.of("experiment_group", {"sessions": "session_id", "unique_users": "customer_id"}, first, last)
        return found.select(
            "experiment_group", "sessions", "unique_users", "purchases", "bounces",
            round_half_up(ratio("purchases", "sessions"), 4).alias("conversion_rate"),
            round_half_up("mean_seconds", 1).alias("avg_session_sec"),
        ).orderBy(F.col("conversion_rate").desc_nulls_last())


SPAN_DAYS = 10


def publish_twice(w: Warehouse, root: str) -> None:
    """Publish the events without their last day and without every third event of the first one, then all of them."""
    ends = w.events.agg(F.struct(F.min(DAY).alias("first"), F.max(DAY).alias("last"))).scalar()
    earlier = w.events.withColumn("ends", ends)
    earlier = earlier.where((F.col(DAY) < F.col("ends.last")) & ((F.col(DAY) > F.col("ends.first")) | (F.col("event_id") % 3 != 0)))
    publish_spans(w.spark, earlier.drop("ends"), root)
    publish_spans(w.spark, w.events, root)
