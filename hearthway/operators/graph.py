"""Connected components of edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthway.session import cut_lineage


def star_components(links: DataFrame, each_round: Callable[[int], None] | None = None) -> DataFrame:
    """(node, root) of every node with a link; the root is the smallest node of its component.

    Alternates two steps. Larger neighbours are linked to the smallest node of a neighbourhood,
    then smaller ones to the smallest of them, until only stars are left; the number of rounds
    grows with the logarithm of the longest chain. Every round is written to the shared folder.
    """
    current = cut_lineage(links.select("a", "b").where("a <> b").distinct())
    number = 0
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a"))
        lowest = down.groupBy("b").agg(F.min("a").alias("m"))
        other = F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a"))
        current = cut_lineage(down.join(lowest, "b").select(F.col("m").alias("a"), other.alias("b")).where("a <> b").distinct())
        number += 1
        if each_round:
            each_round(number)
        leaves = current.groupBy("b").agg(F.count("*").alias("n"))
        roots = current.select(F.col("a").alias("b")).distinct()
        if leaves.where("n > 1").select("b").union(leaves.join(roots, "b").select("b")).isEmpty():
            return current.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                roots.select(F.col("b").alias("node"), F.col("b").alias("root"))
            )
