"""Connected components of a link table, by alternating large-star and small-star steps.

Each step replaces links by links to a smaller node, through grouped minima (combined before the
shuffle) and a join that AQE may split, so a node with very many links is no single task's work.
Before each step nodes whose one link is to a smaller node are set aside: they get its component in the
end. So a node with very many of them is out of the steps, and once none is left the links are stars.
Only whether links are left reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import written


def _to_smallest(links: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large-star) or smaller (small-star) neighbours of each node, and in the
    second case the node itself, to the smallest of them all."""
    if large:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(smallest, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        smallest.select("a", F.col("m").alias("b"))
    )


def _inner(links: DataFrame) -> DataFrame:
    """The links (a, b), a the larger, with ``open``: whether a has another link."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    several = ends.where("up + down > 1 and up > 0").select(F.col("node").alias("a"), F.lit(True).alias("open"))
    return written(links.join(several, "a", "left").select("a", "b", F.coalesce("open", F.lit(False)).alias("open")), "inner")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node in links (a, b)."""

    def clean(x: DataFrame) -> DataFrame:
        return written(x.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    aside = []
    while True:
        seen = _inner(clean(links))
        aside.append(seen.where("not open"))
        links = seen.where("open").select("a", "b")
        if links.isEmpty():
            break
        links = _to_smallest(_to_smallest(links, large=True), large=False)
    found = None
    for leaves in reversed(aside):
        roots = leaves.select("b").distinct()
        if found is None:
            up = leaves.select(F.col("a").alias("node"), F.col("b").alias("component"))
            found = up.union(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
            continue
        known = found.select(F.col("node").alias("b"), "component")
        up = leaves.join(known, "b", "left").select(F.col("a").alias("node"), F.coalesce("component", "b").alias("component"))
        alone = roots.join(known, "b", "left_anti").select(F.col("b").alias("node"), F.col("b").alias("component"))
        found = written(up.union(alone).union(found), "components")
    return found
