"""The operators against brute force on small and lopsided inputs."""

import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cartlens.operators import grouping, histogram, profile, ranking, reshape


def rows(df):
    return sorted(tuple(row) for row in df.collect())


# --- ranks and quantile buckets ----------------------------------------------------------------


def expected_bucket(rank: int, n: int, buckets: int = 5) -> int:
    """Rank r falls into the first bucket whose edge 1 + (n - 1) * b / buckets it does not exceed."""
    return next(b for b in range(1, buckets + 1) if (rank - 1) * buckets <= (n - 1) * b)


def bucketed(spark, pairs):
    df = spark.createDataFrame(pairs, "id bigint, v bigint").withColumn("v", F.col("v").cast("decimal(18,4)"))
    return {row.id: row.v_bucket for row in ranking.quantile_buckets(df, ["v"], "id", 5).collect()}


def brute_buckets(pairs):
    ordered = sorted(pairs, key=lambda pair: (pair[1], pair[0]))
    return {id_: expected_bucket(place, len(pairs)) for place, (id_, _) in enumerate(ordered, start=1)}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 11, 24, 101, 200])
def test_bucket_sizes(spark, n):
    pairs = [(i, n - i) for i in range(n)]
    assert bucketed(spark, pairs) == brute_buckets(pairs)


def test_seven_rows_fall_into_2_1_1_1_2(spark):
    sizes = Counter(bucketed(spark, [(i, i) for i in range(7)]).values())
    assert [sizes[b] for b in range(1, 6)] == [2, 1, 1, 1, 2]


def test_bucket_ends_cover_every_size():
    """The cut rule used by the operator equals the edge rule for all small sizes."""
    for n in range(2, 400):
        ends = [1 + b * (n - 1) // 5 for b in range(1, 5)]
        for rank in range(1, n + 1):
            assert 1 + sum(rank > end for end in ends) == expected_bucket(rank, n)


def test_ties_go_to_the_smaller_key(spark):
    pairs = [(i, 7) for i in range(50)] + [(100 + i, i) for i in range(20)]
    assert bucketed(spark, pairs) == brute_buckets(pairs)


def test_one_row_has_no_bucket(spark):
    assert bucketed(spark, [(1, 5)]) == {1: None}
    assert bucketed(spark, []) == {}


def test_running_total_equals_one_big_window(spark):
    source = random.Random(3)
    data = [("hot" if i % 3 else f"g{i % 7}", source.choice([1, 1, 1, 5, 9]), i, i % 4) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, id int, w int")
    plain = Window.partitionBy("g").orderBy("v", "id")
    expected = df.select(
        "*",
        F.sum("w").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("w").over(Window.partitionBy("g")).alias("overall"),
    )
    actual = ranking.running_total(df, ["g"], ["v", "id"], "w").select(expected.columns)
    assert rows(actual) == rows(expected)


# --- medians -----------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["odd", "even", "tied", "one", "spread"])
def test_median(spark, kind):
    source = random.Random(kind)
    values = {
        "odd": [source.randrange(100) for _ in range(101)],
        "even": [source.randrange(1000) for _ in range(100)],
        "tied": [5] * 500 + [source.randrange(10) for _ in range(99)],
        "one": [42],
        "spread": [source.randrange(10**9) for _ in range(30_000)],
    }[kind]
    data = [("a", v) for v in values] + [("b", v // 2) for v in values] + [("a", None), ("only nulls", None)]
    df = spark.createDataFrame(data, "g string, v bigint")
    result = {row.g: row.median for row in ranking.exact_median(df, "v", ["g"]).collect()}
    assert result == {"a": statistics.median(values), "b": statistics.median([v // 2 for v in values])}


def test_median_without_groups(spark):
    df = spark.createDataFrame([(v,) for v in [1.25, 9.5, 3.0, 4.5]], "v double").select(
        F.col("v").cast("decimal(18,4)").alias("v")
    )
    assert ranking.exact_median(df, "v").first().median == 3.75
    assert ranking.exact_median(df.limit(0), "v").collect() == []


def test_median_of_equal_long_decimals(spark):
    value = "1234567890123.4567"
    df = spark.range(9).select(F.lit(value).cast("decimal(28,4)").alias("v"))
    assert ranking.exact_median(df, "v").first().median == float(value)


def test_median_of_two_million_rows(spark):
    df = spark.range(0, 2_000_001, 1, 8).select((F.col("id") * 7919 % 2_000_001).alias("v"))
    assert ranking.exact_median(df, "v").first().median == 1_000_000


# --- first rows --------------------------------------------------------------------------------


def test_first_rows(spark):
    source = random.Random(1)
    data = [(f"k{source.randrange(10**6):06d}", i) for i in range(5000)] + [(None, i) for i in range(10)]
    df = spark.createDataFrame(data, "k string, i int")
    found = ranking.first_rows(df, ["k", "i"], 700).collect()
    assert [tuple(r) for r in found] == sorted((d for d in data if d[0]), key=lambda d: d)[:700]
    assert ranking.first_rows(df, ["k", "i"]).count() == len(data)


def test_first_rows_sorts_computed_columns(spark):
    df = spark.createDataFrame([(str(i),) for i in range(20, 0, -1)], "id string")
    found = ranking.first_rows(df, [F.col("id").try_cast("decimal(38,0)"), "id"], 3)
    assert [r.id for r in found.collect()] == ["1", "2", "3"] and found.columns == ["id"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "cast" not in plan[plan.index("TakeOrderedAndProject") :].split("output=")[0]


def test_first_rows_reaches_nulls_when_short(spark):
    df = spark.createDataFrame([("b", 1), (None, 2), ("a", 3)], "k string, i int")
    assert [r.i for r in ranking.first_rows(df, ["k", "i"], 3).collect()] == [3, 1, 2]


# --- distinct counts ---------------------------------------------------------------------------


def sample_events():
    source = random.Random(9)
    # One key holds most rows; some keys and counted values are null.
    return [
        ("hot" if source.random() < 0.6 else source.choice(["a", "b", None]),
         source.choice([None, *range(40)]), source.choice(["x", "y", None]), source.choice([None, 1, 2, 3]))
        for _ in range(4000)
    ]


@pytest.mark.parametrize("keep_null_keys", [True, False])
def test_group_with_distincts(spark, keep_null_keys):
    data = sample_events() + [("no values", None, None, None)]
    df = spark.createDataFrame(data, "k string, s int, d string, v int")
    result = grouping.group_with_distincts(
        df, ["k"], [F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")],
        {"sessions": "s", "devices": "d"}, keep_null_keys,
    )
    groups = defaultdict(list)
    for row in data:
        if row[0] is not None or keep_null_keys:
            groups[row[0]].append(row)
    expected = {
        k: (len(g), sum(r[3] or 0 for r in g) if any(r[3] for r in g) else None,
            len({r[1] for r in g} - {None}), len({r[2] for r in g} - {None}))
        for k, g in groups.items()
    }
    assert result.columns == ["k", "n", "total", "sessions", "devices"]
    assert {r.k: tuple(r)[1:] for r in result.collect()} == expected


# --- histograms, matrices, spines, profiles ----------------------------------------------------


def brute_histogram(values, bins):
    low, high = min(values), max(values)
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    edges = [low + i * step for i in range(bins)] + [high]
    return [
        sum(edges[b] <= v and (v < edges[b + 1] or b == bins - 1) for v in values) for b in range(bins)
    ]


@pytest.mark.parametrize("values", [
    [18.0 + i % 60 for i in range(500)], [0.1 * i for i in range(101)], [3.0, 3.0], [-200.0, 600.0, 599.999],
])
def test_histogram(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    result = histogram.histogram(df, F.col("v"), 30).orderBy("bin").collect()
    assert [row.row_count for row in result] == brute_histogram(values, 30)
    assert [row.bin for row in result] == list(range(1, 31))


def test_histogram_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert histogram.histogram(df, F.col("v"), 5).collect() == []


def test_spine_orders_and_fills(spark):
    df = spark.createDataFrame([("Gold", 1), ("Bronze", 2), ("Odd", 3)], "tier string, n int")
    order = ["Bronze", "Silver", "Gold"]
    kept = reshape.along_spine(df, "tier", order, keep_absent=True)
    assert [tuple(r) for r in kept.collect()] == [("Bronze", 2), ("Silver", None), ("Gold", 1)]
    dropped = reshape.along_spine(df, "tier", order, keep_absent=False)
    assert [tuple(r) for r in dropped.collect()] == [("Bronze", 2), ("Gold", 1)]


def test_count_matrix(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 3)], "k string, h int")
    result = reshape.count_matrix(df, "k", "h", [1, 2, 3], ["one", "two", "three"])
    assert result.columns == ["k", "one", "two", "three"]
    assert rows(result) == [("a", 2, 0, 0), ("b", 0, 0, 1)]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (None, None)], "a int, b string")
    assert rows(profile.null_counts(df, "t")) == [("t", 3, "a", "int", 1), ("t", 3, "b", "string", 2)]
    assert rows(profile.table_sizes({"t": df, "u": df.limit(1)})) == [("t", 3, 2), ("u", 1, 2)]
