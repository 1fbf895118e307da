"""Distinct counts from bits kept per day: equal to counting the events, only changed days written."""

import random

from pyspark.sql import functions as F

from cartlens.operators.distinct_bits import bit_words, count_bits, number_ids
from cartlens.plans import marts, publish, spans, sql_reports
from cartlens.plans.clean import clean_events
from cartlens.plans.spans import Spans, publish_spans, span_tables
from cartlens.sources import generations
from tests.test_publish import base, clicks, raw


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


class Events:
    """What a report reads of a warehouse."""

    def __init__(self, events):
        self.events = events


def check(spark, root, events, first=None, last=None):
    kept = Spans(spark, root)
    if first:
        events = events.where(F.col("date") >= first)
    if last:
        events = events.where(F.col("date") <= last)
    same(kept.customers(first, last), marts.customer_event_agg(events))
    same(kept.campaigns(first, last), marts.campaign_event_agg(events))
    same(kept.groups(first, last), sql_reports.ab_groups(Events(events)))


def many(seed, days=5, number=160):
    draw = random.Random(seed)
    rows = []
    for i in range(number):
        # One customer owns a third of the events; nulls in everything that is counted or grouped by.
        customer = draw.choice([1, draw.randrange(200), draw.randrange(200)])
        rows.append(dict(
            event_id=i, timestamp=draw.choice([None] + [f"2024-02-0{d + 1} 10:00:00" for d in range(days)] * 5),
            customer_id=customer, session_id=draw.choice([None, draw.randrange(300), draw.randrange(300)]),
            device_type=draw.choice([None, "mobile", "desktop"]), campaign_id=draw.randrange(4),
            experiment_group=draw.choice([None, "Control", "Variant_A"]), event_type=draw.choice(["purchase", "bounce", "view"]),
        ))
    return rows + rows[:20]


def cleaned(spark, rows):
    return clean_events(raw(spark, events=rows)["events"])


def test_words_merge_to_distinct_counts(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), d, draw.choice([None, f"id{draw.randrange(500)}"])) for d in range(4) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, d int, id string")
    ids = df.where("id is not null").select("id").distinct()
    numbers = number_ids(ids, ["id"], first=61)
    assert sorted(r.number for r in numbers.collect()) == list(range(61, 61 + ids.count()))
    words = bit_words(df, ["k", "d"], "id", numbers)
    for days in ([0], [1, 3], [0, 1, 2, 3]):
        found = {r.k: r.n for r in count_bits(words.where(F.col("d").isin(days)), ["k"], "n").collect()}
        expected = {k: len({i for key, d, i in rows if key == k and d in days and i is not None}) for k in ("a", "b", None)}
        assert found == expected
    # The sign bit of a word is a bit like the others.
    whole = spark.range(128).selectExpr("0 as k", "id", "id as number")
    assert [r.bits for r in bit_words(whole, ["k"], "id", whole.select("id", "number")).collect()] == [-1, -1]
    assert count_bits(bit_words(whole, ["k"], "id", whole.select("id", "number")), ["k"], "n").first().n == 128


def test_any_span_equals_counting_the_events(spark, tmp_path):
    root, events = str(tmp_path), cleaned(spark, many(1))
    publish_spans(spark, events, root)
    check(spark, root, events)
    check(spark, root, events, "2024-02-02", "2024-02-03")
    check(spark, root, events, None, "2024-02-01")
    assert Spans(spark, root).last_days(3) == ("2024-02-03", "2024-02-05")


def test_one_changed_day(spark, tmp_path):
    root, rows = str(tmp_path), clicks(6)
    publish_spans(spark, cleaned(spark, rows), root)
    held = Spans(spark, root)
    before = sorted(map(str, held.customers().collect()))
    rows[13] |= dict(session_id=999, customer_id=77)
    rows.append(dict(event_id=5000, timestamp="2024-01-09 00:00:00", customer_id=500, session_id=3))
    changed = cleaned(spark, rows)
    found = {(r.table_name, r.part, r.change) for r in publish_spans(spark, changed, root).collect()}
    check(spark, root, changed)
    check(spark, root, changed, "2024-01-03", "2024-01-09")
    assert {part for name, part, _ in found if name.startswith(("span_bits", "span_sums"))} == {"2024-01-03", "2024-01-09"}
    # New ids came as a batch of their own.
    assert ("span_ids_customer_id", "1", "added") in found and ("span_ids_session_id", "1", "added") in found
    assert not any(name.startswith("span_ids") and part == "0" for name, part, _ in found)
    numbers = [r.number for r in publish.open_published(spark, root).table("span_ids_customer_id").collect()]
    assert sorted(numbers) == list(range(len(numbers)))
    # Folders of other days are those of the first generation, and who opened it still reads it.
    names = generations.manifest(spark, root, 2).where("table_name like 'span_bits%' and part not in ('2024-01-03', '2024-01-09')")
    assert names.join(generations.manifest(spark, root, 1), ["table_name", "part", "folder"], "left_anti").count() == 0
    assert sorted(map(str, held.customers().collect())) == before
    assert publish_spans(spark, changed, root).count() == 0 and generations.published(spark, root) == [1, 2]


def test_removed_days_and_empty_events(spark, tmp_path):
    root = str(tmp_path)
    publish_spans(spark, cleaned(spark, clicks(4)), root)
    fewer = cleaned(spark, [r for r in clicks(4) if not r["timestamp"].startswith("2024-01-02")])
    publish_spans(spark, fewer, root)
    check(spark, root, fewer)
    none = fewer.limit(0)
    publish_spans(spark, none, root)
    check(spark, root, none)
    assert Spans(spark, root).last_days(5) == (None, None)
    again = cleaned(spark, many(4))
    publish_spans(spark, again, root)
    check(spark, root, again, "2024-02-02", None)


def test_spans_in_the_warehouse(spark, tmp_path):
    root = str(tmp_path)
    publish.publish_warehouse(spark, base(spark), root, more=spans.keep_spans)
    later = base(spark, events=clicks(7))
    publish.publish_warehouse(spark, later, root, more=spans.keep_spans)
    check(spark, root, publish.open_published(spark, root).events)
    assert set(span_tables()) <= {r.table_name for r in generations.manifest(spark, root).collect()}


def test_no_event_is_read(spark, tmp_path):
    root = str(tmp_path)
    publish_spans(spark, cleaned(spark, clicks(6)), root)
    frame = Spans(spark, root).campaigns("2024-01-02", "2024-01-03")
    assert {path.split(root)[1].split("/")[1] for path in frame.inputFiles()} == {"span_sums_campaign_id", "span_bits_campaign_id_customer_id"}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(date") == 2
