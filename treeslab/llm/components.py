"""Connected components of a graph given by its links, without collecting it.

Large-star and small-star steps in turn: each hangs the neighbours of a vertex on the least
of them, so the links become stars around the least vertex of each component in a number
of rounds that grows with the logarithm of the component's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeslab.llm.shared import shared_dir


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b), a > b."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, component) for each vertex of the links (a, b) that isn't the least of its component."""
    shared_dir(links.sparkSession)
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct().checkpoint()
    mark = lambda x: tuple(x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = None
    while (now := mark(links)) != before:
        before = now
        links = _star(_star(links, True), False).checkpoint()
    return links.select(F.col("a").alias("v"), F.col("b").alias("component"))
