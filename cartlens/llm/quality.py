"""Quality rules from robust multivariate outliers, in DataFrame functions alone.

Four counts of every text go, as transformed rates, into a vector of five statistics. For every pool of
documents a minimum-covariance-determinant estimate is found: starting from two estimates (medians
with median deviations, and plain moments), the nearest COVERED share of the pool's documents gives
the next mean and covariance, STEPS times; the start with the smaller determinant is used. Documents
whose squared Mahalanobis distance is above the CUT quantile of chi-square are rejected.

A pool is a language and source. Groups of fewer than `least` documents are pooled by language, and if
that is too small, together; a last pool that is still smaller has no estimate and rejects nothing.
Documents that fail the base rules are in no pool. Null languages and sources are values of their own.

Statistics are whole numbers of ten-thousandths and sums of products are exact, so estimates do not
depend on the order of rows. Distances fall into narrow classes whose counts give the covered share; no
pool is sorted or gathered.

Null and empty texts have zero counts and fail the base rules. Every input row gives one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import WORD, pick, stage

LEAST_WORDS = 50
LEAST_DOCUMENTS = 50
COVERED = 0.75
STEPS = 4
CUT = 0.999999
UNIT = 10_000
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = ("x0", "x1", "x2", "x3", "x4")
# Deviations that every pool has at least, in the units of the statistics: a rate that is nearly always
# zero has no variance to measure by.
FLOORS = (0.3, 0.1, 0.5, 0.5, 0.5)
# Classes of distances per doubling.
CLASSES = 32
EXACT = "decimal(38,0)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pairs(a: Column, n: Column, body: Callable[[Column, Column], Column]) -> Column:
    """`body` of each two neighbours of an array of n > 0 elements."""
    return F.zip_with(F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1), body)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more."""

    def covered(places: Column) -> Column:
        steps = pairs(places, F.size(places), lambda a, b: F.least(F.lit(3), b - a))
        return F.aggregate(steps, F.lit(3), lambda total, step: total + step)

    def of_windows(windows: Column) -> Column:
        n = F.size(windows)
        placed = F.zip_with(windows, F.sequence(F.lit(1), n), lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def of_sorted(s: Column) -> Column:
            equal = pairs(s, n, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
            return let(F.array_sort(F.array_distinct(F.flatten(equal))), covered)

        return F.when(F.size(F.array_distinct(windows)) == n, F.lit(0)).otherwise(let(F.array_sort(placed), of_sorted))

    def of_words(w: Column) -> Column:
        n = F.size(w) - 2
        two = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        three = F.zip_with(two, F.slice(w, F.lit(3), n), lambda h, c: F.xxhash64(h, c))
        return F.when(n < 2, F.lit(0)).otherwise(let(three, of_windows))

    return let(words, of_words)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts and base_failed of every row."""
    rows = pick(docs, doc_id="long", text="string", lang="string", source="string")
    text = F.coalesce("text", F.lit(""))
    bare = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))
    counted = rows.select(
        "doc_id", "lang", "source",
        let(words, of_words).alias("of_words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", "of_words.*", "n_symbols", "n_dup_lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def transformed(counts: DataFrame) -> DataFrame:
    """`counts` with the statistics, logarithms of size, word length and rates per hundred words."""
    n = F.col("n_words")
    rate = lambda name: F.log1p(F.col(name) * 100 / n)
    values = [F.log(n.cast("double")), F.log(F.col("word_chars") / n), rate("n_symbols"), rate("n_dup_lines"), rate("n_repeat_words")]
    return counts.withColumns({x: F.round(v * UNIT).cast("long") for x, v in zip(STATISTICS, values)})


def pooled(rows: DataFrame, least: int) -> DataFrame:
    """`rows` with `pool`, null where there are too few documents to compare with."""
    def part(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null"))

    sizes = stage(rows.groupBy("lang", "source").count(), "groups")
    by_language = sizes.withColumn("small", F.col("count") < least)
    # Summed before the windows: a language has one row per source here, all sources one per language.
    languages = by_language.where("small").groupBy("lang").agg(F.sum("count").alias("of_language"))
    tiny = languages.where(F.col("of_language") < least)
    rest = tiny.agg(F.sum("of_language")).scalar()
    languages = languages.select(F.col("lang").alias("l"), "of_language")
    named = by_language.join(languages, F.col("lang").eqNullSafe(F.col("l")), "left")
    pool = (
        F.when(~F.col("small"), F.concat_ws("\x01", part("lang"), part("source")))
        .when(F.col("of_language") >= least, F.concat_ws("\x01", part("lang")))
        .when(rest >= least, F.lit(""))
    )
    named = stage(named.select(F.col("lang").alias("l"), F.col("source").alias("s"), pool.alias("pool")), "pools")
    return rows.join(named, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")


def estimate(rows: DataFrame) -> DataFrame:
    """pool, m0.. (means) and l00.. (triangular factor of the covariance) of each non-null pool."""
    rows = rows.where(F.col("pool").isNotNull()).select("pool", *STATISTICS)
    sizes = stage(rows.groupBy("pool").agg(F.count(F.lit(1)).alias("n")), "sizes")
    needed = F.ceil(F.col("n") * COVERED)

    middles = rows.groupBy("pool").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(STATISTICS)])
    middles = stage(middles, "medians")
    apart = [F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"d{i}") for i, x in enumerate(STATISTICS)]
    apart = rows.join(middles, "pool").groupBy("pool", *[f"m{i}" for i in range(5)]).agg(*apart)
    robust = apart.select(
        "pool", F.lit(0).alias("start"), *[(F.col(f"m{i}") / UNIT).alias(f"m{i}") for i in range(5)],
        *[
            (F.pow(F.col(f"d{i}") * 1.4826 / UNIT, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
            for i in range(5) for j in range(i + 1)
        ],
    )
    plain = moments(rows.withColumn("start", F.lit(1)))
    current = stage(factored(robust.unionByName(plain)), "estimate")
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(STEPS):
        near = distances(both.join(current, ["pool", "start"])).select("pool", "start", *STATISTICS, distance_class("distance").alias("class"))
        near = stage(near, "distances")
        through = Window.partitionBy("pool", "start").orderBy("class")
        # One row per class: some hundred at most for a pool.
        counts = near.groupBy("pool", "start", "class").count().withColumn("upto", F.sum("count").over(through))
        last = counts.join(sizes, "pool").where(F.col("upto") >= needed).groupBy("pool", "start").agg(F.min("class").alias("last"))
        inside = near.join(last, ["pool", "start"]).where(F.col("class") <= F.col("last"))
        current = stage(factored(moments(inside)), "estimate")
    best = current.groupBy("pool").agg(F.min_by("start", F.struct("volume", "start")).alias("start"))
    return stage(current.join(best, ["pool", "start"]).drop("start", "volume"), "best")


def moments(rows: DataFrame) -> DataFrame:
    """Means and covariances per pool and start, from exact sums."""
    pairs_of = [(i, j) for i in range(5) for j in range(i + 1)]
    sums = rows.groupBy("pool", "start").agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        *[F.sum(F.col(x).cast(EXACT)).cast("double").alias(f"s{i}") for i, x in enumerate(STATISTICS)],
        *[F.sum((F.col(f"x{i}") * F.col(f"x{j}")).cast(EXACT)).cast("double").alias(f"p{i}{j}") for i, j in pairs_of],
    )
    means = [(F.col(f"s{i}") / F.col("k") / UNIT).alias(f"m{i}") for i in range(5)]
    covs = [
        ((F.col(f"p{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("k")) / F.col("k") / UNIT**2).alias(f"c{i}{j}")
        for i, j in pairs_of
    ]
    return sums.select("pool", "start", *means, *covs)


def factored(estimates: DataFrame) -> DataFrame:
    """Covariances with the least variances added, as lower triangular factors; volume is the log determinant."""
    out = estimates
    for j in range(5):
        rest = F.col(f"c{j}{j}") + FLOORS[j] ** 2
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))))
        for i in range(j + 1, 5):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    out = out.withColumn("volume", sum((F.log(f"l{i}{i}") for i in range(1, 5)), F.log("l00")))
    factors = [f"l{i}{j}" for i in range(5) for j in range(i + 1)]
    return out.select("pool", "start", *[f"m{i}" for i in range(5)], *factors, "volume")


def distances(rows: DataFrame) -> DataFrame:
    """`rows` joined with estimates, with `distance`, the squared Mahalanobis distance."""
    out = rows
    for i, x in enumerate(STATISTICS):
        rest = F.col(x) / UNIT - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return out.withColumn("distance", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, 5)), F.col("z0") * F.col("z0")))


def distance_class(distance: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(distance), F.lit(1e-6))) * CLASSES).cast("int")


def chi_square_cdf(x: float, freedom: int) -> float:
    """Series of the regularised incomplete gamma function."""
    a, x = freedom / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > 1e-16 * total:
        term *= x / (a + n)
        total += term
        n += 1
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi_square_quantile(share: float, freedom: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, freedom) < share else (low, middle)
    return high


def quality(docs: DataFrame, least: int = LEAST_DOCUMENTS, cut: float = CUT) -> DataFrame:
    """The counts, base_failed, pool, distance (null without an estimate) and kept of every row."""
    counts = stage(measured(docs), "counts")
    # A pool's covariance is that of its nearest part; this makes it the whole's if that is normal.
    freedom = len(STATISTICS)
    inner = chi_square_quantile(COVERED, freedom)
    scale = COVERED / chi_square_cdf(inner, freedom + 2)
    passing = stage(pooled(transformed(counts.where("NOT base_failed")), least), "passing")
    judged = distances(passing.join(estimate(passing), "pool", "left"))
    columns = ("doc_id", *COUNTS, "base_failed")
    kept = F.coalesce(F.col("distance") / scale <= chi_square_quantile(cut, freedom), F.lit(True))
    failed = counts.where("base_failed").select(
        *columns, F.lit(None).cast("string").alias("pool"), F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")
    )
    return judged.select(*columns, "pool", (F.col("distance") / scale).alias("distance"), kept.alias("kept")).union(failed)
