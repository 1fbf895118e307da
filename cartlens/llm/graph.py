"""Connected components of a graph that is kept as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.llm.common import stage

JUMPS = 3


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node in `links` (a, b: long).

    In a round every node points to its smallest neighbour or itself, pointers are shortened by
    joining the table with itself, and links are moved to the ends of the pointers. Links inside one
    end vanish, so the table shrinks from round to round. Every table of a round is written to the
    shared folder. Only counts reach the driver. Links with a null end are ignored.
    """
    links = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Folded before it is shuffled: a node with very many neighbours sends one row per task.
        pointers = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root"))
        pointers = stage(pointers, "pointers")
        for _ in range(JUMPS):
            pointers = stage(_follow(pointers, pointers), "pointers")
        roots = pointers if roots is None else stage(_follow(roots, pointers), "roots")
        ends = pointers.withColumnRenamed("node", "a").withColumnRenamed("root", "from")
        moved = links.join(ends, "a").select("from", "b")
        ends = pointers.withColumnRenamed("node", "b").withColumnRenamed("root", "to")
        moved = moved.join(ends, "b").where(F.col("from") != F.col("to"))
        links = stage(moved.select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).distinct(), "links")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _follow(table: DataFrame, pointers: DataFrame) -> DataFrame:
    """`table` (node, root) with each root replaced by where it points; ends of pointers stay."""
    onward = pointers.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("further"))
    return table.join(onward, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
