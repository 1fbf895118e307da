"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share a budget of words by weight; what a source cannot hold under its cap goes to
the others by weight, until none is above its cap.

Documents: a source that has to give rate = target / size of its words expects rate copies of a
document on average, a little more of longer ones: expected = rate + tilt * (preference - mean
preference), where the mean is weighted by size, so that the expected words are the target. The
tilt is the distance of the rate to 0 or the cap, so no expectation leaves that range. The whole part of an
expectation is allocated for certain. The rest is its probability p of one copy more: documents are
ranked by random odds over inclusion odds, u / (1 - u) / (p / (1 - p)), with u a hash of the id, and
taken in that order up to the size that is left. The last one is taken if that comes nearer.

The order is never sorted as a whole: ranks fall into fixed slices, slices are summed, and only the
slice in which a source's remaining size ends is sorted.

Null and empty texts have size 0 and are never taken. Null is a source of its own, the last. Rows that
share an id share u and are told apart by size; equal rows are taken or left together, as ranks tie.
A null id is allowed. Every input row gives one row, with `copies`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import WORD, documents, pick, stage
from cartlens.operators.ranking import running_total

WEIGHTS = (5, 2, 1)
BUDGET = (3, 2)  # words of the mix over words of all documents: 150 %
CAP = 2
# Preference of a document: size / (size + HALF), in thousandths.
HALF = 256
# Slices of the order of a source: bounds what is sorted in one task.
SLICES = 1 << 16
EXACT = "decimal(38,0)"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size in words."""
    rows = pick(docs, doc_id="long", text="string", source="string")
    return rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = BUDGET, cap: int = CAP) -> DataFrame:
    """`sources` (source, source_size: one row each) with `target` in words.

    Whole numbers decide, so the result does not depend on the order of sums. Sources are filled in
    order of cap over weight; one is full if its weight's share of what is left is above its cap.
    """
    # Windows without a partition would pull all sources into one task: ranks come in slices.
    ranked = running_total(
        sources.withColumn("everything", F.lit(0)).withColumn("one", F.lit(1)).withColumn("last", F.col("source").isNull()),
        ["everything"], ["last", "source"], "one",
    )
    kinds = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.select(
        "source", "last", "everything", "source_size",
        F.get(kinds, ((F.col("upto") - 1) % len(weights)).cast("int")).cast("long").alias("weight"),
    )
    weighed = weighed.withColumn("fill", F.col("source_size") * cap / F.col("weight"))
    by_fill = ["fill", "last", "source"]
    caps = running_total(weighed.withColumn("cap", (F.col("source_size") * cap).cast(EXACT)), ["everything"], by_fill, "cap")
    caps = caps.withColumnRenamed("upto", "caps_upto").withColumnRenamed("overall", "caps")
    both = running_total(caps, ["everything"], by_fill, "weight")
    total = F.floor(F.col("caps") / cap * budget[0] / budget[1]).cast(EXACT)
    rest = total - (F.col("caps_upto") - F.col("cap"))
    weights_left = F.col("overall") - F.col("upto") + F.col("weight")
    filled = stage(both.withColumn("full", F.col("cap") * weights_left <= F.col("weight") * rest).withColumn("total", total), "targets")
    left = filled.agg(
        F.struct(
            (F.max("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))), F.lit(0))).cast("double").alias("words"),
            F.sum(F.when(~F.col("full"), F.col("weight"))).cast("double").alias("weights"),
        )
    ).scalar()
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * left.getField("words") / left.getField("weights")
    )
    return filled.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of the id's MD5."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: tuple[int, int] = BUDGET, cap: int = CAP
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row of `docs`."""
    rows = stage(sized(docs), "sized")
    rows = rows.withColumn("preference", F.floor(F.col("size") * 1000 / (F.col("size") + HALF)).cast("long"))
    sources = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") * F.col("preference")).cast(EXACT)).alias("preferred")
    )
    sources = stage(sources, "sources")
    aimed = sources.join(
        targets(sources.select("source", "source_size"), weights, budget, cap).select(F.col("source").alias("s"), "target"),
        F.col("source").eqNullSafe(F.col("s")),
    ).select("s", "source_size", "target", "preferred")
    # A source is a few numbers: the planner broadcasts the written table if it is small enough.
    aimed = stage(aimed, "aimed")
    known = rows.join(aimed, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mean = F.when(F.col("source_size") > 0, F.col("preferred").cast("double") / F.col("source_size")).otherwise(0.0)
    # Within 1e-9 of a whole number nothing is left to chance.
    expected = F.round(rate + F.least(rate, cap - rate) * (F.col("preference") - mean) / 1000, 9)
    u = uniform(F.col("doc_id"))
    odds = u / (1 - u)
    drawn = known.withColumn("expected", expected).withColumn("sure", F.floor("expected").cast("long"))
    p = F.col("expected") - F.col("sure")
    # Odds over odds, written as a share between 0 and 1 that has the same order.
    order = F.when((p > 0) & (F.col("size") > 0), odds * (1 - p) / (odds * (1 - p) + p))
    drawn = drawn.withColumn("order", order)
    drawn = stage(drawn.withColumn("slice", F.least(F.floor(F.col("order") * SLICES), F.lit(SLICES - 1)).cast("int")), "drawn")

    slices = drawn.groupBy("source", "slice").agg(
        F.sum(F.col("sure") * F.col("size")).alias("sure_words"),
        F.sum(F.when(F.col("slice").isNotNull(), F.col("size")).otherwise(0)).alias("words"),
        F.max("target").alias("goal"),
    )
    # At most SLICES + 1 rows of a source meet here. Null, the documents without chance, comes first.
    through = Window.partitionBy("source").orderBy(F.col("slice").asc_nulls_first())
    slices = (
        slices.withColumn("left", F.col("goal") - F.sum("sure_words").over(Window.partitionBy("source")))
        .withColumn("upto", F.sum("words").over(through))
        .withColumn("before", F.col("upto") - F.col("words"))
    )
    # Slices that are taken or left as a whole need no sorting.
    cut = stage(
        slices.where((F.col("before") <= F.col("left")) & (F.col("upto") > F.col("left")) & F.col("slice").isNotNull())
        .groupBy(F.col("source").alias("s"))
        .agg(F.min_by(F.struct("slice", "before", "left"), "slice").alias("cut")),
        "cut",
    )
    placed = drawn.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = F.col("slice") == F.col("cut.slice")
    ties = placed.where(inside).groupBy("source", "order", "doc_id", "size", "cut").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum(F.col("size") * F.col("rows")).over(Window.partitionBy("source").orderBy("order", F.col("doc_id").asc_nulls_last(), "size"))
    ends = ties.withColumn("end", F.col("cut.before") + upto).withColumn("begin", F.col("end") - F.col("size") * F.col("rows"))
    # The one that crosses the end is taken if the end then is nearer than before it.
    chosen = ends.where(
        (F.col("end") <= F.col("cut.left"))
        | ((F.col("begin") < F.col("cut.left")) & (F.col("end") - F.col("cut.left") <= F.col("cut.left") - F.col("begin")))
    )
    chosen = chosen.select(F.col("source").alias("s"), F.col("order").alias("o"), F.col("doc_id").alias("d"), F.col("size").alias("z"))
    marked = placed.join(
        chosen,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("order") == F.col("o"))
        & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z")),
        "left",
    )
    extra = F.when(F.col("slice").isNull(), False).when(F.col("cut").isNull(), True)
    extra = extra.when(F.col("slice") < F.col("cut.slice"), True).otherwise(F.col("z").isNotNull())
    copies = F.when(F.col("size") > 0, F.col("sure") + extra.cast("long")).otherwise(F.lit(0))
    return marked.withColumn("copies", copies.cast("long")).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    docs = documents(docs)
    copies = mix(docs).where("copies > 0").select(
        F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "copies"
    )
    # Rows that agree in all three have the same number of copies.
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    met = docs.withColumn("mixed_size", size).join(
        copies.distinct(),
        F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("mixed_size") == F.col("z")),
    )
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
