"""Generations: only what changed is written, all tables appear together, equal to a full build."""

import os

import pytest
from pyspark.sql import functions as F

from cartlens.plans import publish
from cartlens.plans.warehouse import MARTS, build_warehouse
from cartlens.sources import generations
from cartlens.sources.schemas import RAW_COLUMNS, text_schema
from tests.test_clean import DEFAULTS

TABLES = ["campaigns", "customers", "events", "products", "transactions", *MARTS]


def raw(spark, **rows):
    """Raw frames; what is not given is one row of defaults."""
    out = {}
    for name, columns in RAW_COLUMNS.items():
        data = [[None if (v := (DEFAULTS[name] | row)[c]) is None else str(v) for c in columns] for row in rows.get(name, [{}])]
        out[name] = spark.createDataFrame(data, text_schema(columns))
    return out


def sales(days, customers=6, **more):
    return [
        dict(transaction_id=f"{d}-{c}", timestamp=f"2024-0{1 + d % 3}-1{d % 9} 10:00:00", customer_id=c, product_id=c % 3, gross_revenue=10 * d + c, **more)
        for d in range(days) for c in range(customers) if (d + c) % 4
    ]


def clicks(days, customers=6):
    return [
        dict(event_id=100 * d + c, timestamp=f"2024-01-0{d + 1} 0{c}:00:00", customer_id=c, session_id=d * 10 + c, event_type=("view", "click", "purchase", "bounce")[(d + c) % 4], campaign_id=c % 3)
        for d in range(days) for c in range(customers)
    ]


def base(spark, **changed):
    rows = dict(
        transactions=sales(9), events=clicks(6), customers=[dict(customer_id=c) for c in range(8)],
        products=[dict(product_id=p) for p in range(3)], campaigns=[dict(campaign_id=c) for c in range(3)],
    )
    return raw(spark, **(rows | changed))


def assert_same(found, expected):
    for name in TABLES:
        a, b = getattr(found, name), getattr(expected, name)
        assert set(a.columns) == set(b.columns), name
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect())), name


def changes_of(df):
    return {(r.table_name, r.part, r.change) for r in df.collect()}


def test_one_changed_day(spark, tmp_path):
    root = str(tmp_path / "w")
    publish.publish_warehouse(spark, base(spark), root)
    assert_same(publish.open_published(spark, root), build_warehouse(spark, base(spark), str(tmp_path / "full")))
    held = publish.open_published(spark, root)
    before = held.events.count(), held.funnel.collect()

    later = clicks(6)
    later[13]["session_duration_sec"] = 77
    later[14]["customer_id"] = 7
    changed = base(spark, events=later)
    found = changes_of(publish.publish_warehouse(spark, changed, root))
    assert {x for x in found if x[0] in ("events", "transactions", "customers")} == {("events", "2024-01-03", "rewritten")}
    assert not any(x[0] == "mart_product_performance" for x in found)
    assert_same(publish.open_published(spark, root), build_warehouse(spark, changed, str(tmp_path / "full2")))
    assert (held.events.count(), held.funnel.collect()) == before
    assert publish.open_published(spark, root, 1).events.exceptAll(held.events).count() == 0

    # All but the last generation go, with the folders of that day that only the first one named.
    assert generations.clear(spark, root) > 0
    assert generations.published(spark, root) == [2]
    assert_same(publish.open_published(spark, root), build_warehouse(spark, changed, str(tmp_path / "full3")))


def test_added_and_removed_partitions_and_nulls(spark, tmp_path):
    root = str(tmp_path / "w")
    publish.publish_warehouse(spark, base(spark), root)
    rows = [r for r in sales(9) if not r["timestamp"].startswith("2024-02")]
    rows += [dict(transaction_id="new", timestamp="2024-07-01 00:00:00", customer_id=3, gross_revenue=1000, refund_flag=0)] * 2
    rows += [dict(transaction_id="x", timestamp=None, customer_id=5)]
    changed = base(spark, transactions=rows)
    found = changes_of(publish.publish_warehouse(spark, changed, root))
    assert {x for x in found if x[0] == "transactions"} == {
        ("transactions", "2024-02", "removed"), ("transactions", "2024-07", "added"), ("transactions", None, "added")}
    assert_same(publish.open_published(spark, root), build_warehouse(spark, changed, str(tmp_path / "full")))
    assert changes_of(publish.publish_warehouse(spark, changed, root)) == set()
    assert generations.published(spark, root) == [1, 2]


def test_empty_tables(spark, tmp_path):
    root = str(tmp_path / "w")
    empty = {name: df.limit(0) for name, df in base(spark).items()}
    publish.publish_warehouse(spark, empty, root)
    assert publish.open_published(spark, root).transactions.count() == 0
    publish.publish_warehouse(spark, base(spark), root)
    assert_same(publish.open_published(spark, root), build_warehouse(spark, base(spark), str(tmp_path / "full")))


def test_a_build_that_dies_leaves_the_former_warehouse(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "w")
    publish.publish_warehouse(spark, base(spark), root)
    expected = sorted(map(str, publish.open_published(spark, root).customer_360.collect()))

    def die(t):
        raise KeyError("killed")

    monkeypatch.setitem(publish.MARTS, "funnel", die)
    with pytest.raises(KeyError):
        publish.publish_warehouse(spark, base(spark, events=clicks(3), transactions=sales(4)), root)
    assert generations.published(spark, root) == [1]
    assert sorted(map(str, publish.open_published(spark, root).customer_360.collect())) == expected
    # What it had written is named by no manifest.
    assert generations.clear(spark, root) > 0
    assert sorted(map(str, publish.open_published(spark, root).customer_360.collect())) == expected
    assert len(os.listdir(tmp_path / "w" / "events")) == 2 - 1


def test_two_runs_cannot_publish_one_number(spark, tmp_path):
    files = generations.Files(spark, str(tmp_path))
    files.appear(str(tmp_path / "1"), "a")
    with pytest.raises(RuntimeError, match="meanwhile"):
        files.appear(str(tmp_path / "1"), "b")
    assert files.read(str(tmp_path / "1")) == "a"
    with pytest.raises(ValueError, match="nothing was published"):
        publish.open_published(spark, str(tmp_path / "none"))


def test_partitions_are_pruned(spark, tmp_path):
    root = str(tmp_path / "w")
    publish.publish_warehouse(spark, base(spark), root)
    one = publish.open_published(spark, root).events.where("date = DATE '2024-01-02'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and one.count() == 6


def test_fingerprints_tell_exchanged_values(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "i int, t string")
    other = spark.createDataFrame([(1, "b"), (2, "a"), (None, "c")], "i int, t string")
    moved = spark.createDataFrame([(None, "c"), (2, "b"), (1, "a")], "i int, t string").repartition(3)
    content = [generations.fingerprints(df, "t").first().content for df in (one, other, moved)]
    assert content[0] == content[2] != content[1]
    assert generations.fingerprints(one.withColumn("p", F.lit("x")), "t", "p").first().row_count == 3


def test_a_first_publication_computes_a_table_once(spark, tmp_path):
    """Its fingerprints come from what was written, and equal those of the frame."""
    seen = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    plain = spark.createDataFrame([(1, "a"), (2, None), (None, "a"), (2, None)], "n long, part string")
    run = publish.Publication(spark, str(tmp_path / "w"))
    run.add("numbers", plain.mapInArrow(noted, plain.schema), "part")
    assert seen.value == 4
    found = {(row["part"], row["row_count"], row["content"]) for row in run.rows["numbers"]}
    assert found == {(row.part, row.row_count, row.content) for row in generations.fingerprints(plain, "numbers", "part").collect()}
    assert {(c["part"], c["change"]) for c in run.changes} == {("a", "added"), (None, "added")}
    run.add("nothing", plain.limit(0), "part")
    assert [(row["row_count"], row["folder"]) for row in run.rows["nothing"]] == [(0, None)] and run.table("nothing").count() == 0


def test_most_keys_are_folded_without_a_look_up(spark, tmp_path, monkeypatch):
    root, folded = str(tmp_path / "w"), []
    publish.publish_warehouse(spark, base(spark), root)

    def plan_of(function):
        def fold(df):
            folded.append(df._jdf.queryExecution().optimizedPlan().toString())
            return function(df)

        return fold

    monkeypatch.setattr(publish, "FOLDS", {name: (plan_of(f), fact, key) for name, (f, fact, key) in publish.FOLDS.items()})
    later = base(spark, transactions=[row | dict(gross_revenue=1) for row in sales(9)], events=clicks(7))
    publish.publish_warehouse(spark, later, root)
    assert len(folded) > len(publish.FOLDS) and not any("touched" in plan for plan in folded if "transaction_id" in plan)
    assert_same(publish.open_published(spark, root), build_warehouse(spark, later, str(tmp_path / "full")))
