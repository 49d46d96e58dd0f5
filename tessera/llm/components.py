"""Connected components of a link table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours are linked to its least neighbour (or itself).

    A hot node is never gathered: its least neighbour is a partial aggregate,
    joined back to its links.
    """
    if large:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    kept = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return kept.where("a <> b").distinct()


def components(pairs: DataFrame, tmp: Scratch, label: str) -> DataFrame:
    """``node, root`` for every node of ``pairs(a, b)``: the least node that its links reach."""
    now = tmp.table(f"{label}-0", pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, step = None, 0
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark, step = tuple(found), step + 1
        now = tmp.table(f"{label}-{step}", _star(_star(now, large=True), large=False))
        tmp.forget(f"{label}-{step - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
