"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagemill.llm.common import hot_join, stage_table


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) with m, the least of u and its neighbours. A star's centre may be on most rows."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("rows"))
    return hot_join(edges, least, ["u"])


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars: no end has two centres, and no centre has one of its own."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node and component (its least reachable node) for each node of links (u, v); links may repeat and point either way, null ends and loops count for nothing.

    Large-star and small-star in turn: every node is tied to the least of its neighbourhood until each component is a star. Each round is a table in the shared folder; the rounds needed grow with the logarithm of the longest path, and end by themselves as labels only fall. Links that are stars already take no round.
    """
    now = links.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage_table(now, "links")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        small = _with_least(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = stage_table(small, "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component) with what more links (u, v) join, whose nodes need not be in found. Only the links between different components go through rounds; if there are none, found is the answer."""
    name = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    named = links.select("u", "v").join(name("u"), "u", "left").join(name("v"), "v", "left")
    between = named.select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v")).filter("u <> v")
    between = stage_table(between.distinct(), "new-links")
    if between.isEmpty():
        return found
    new = stage_table(components(between), "joined")
    old = found.groupBy("component").agg(F.count("*").alias("rows"))
    renamed = new.select(F.col("node").alias("component"), F.col("component").alias("least")).join(old, "component")
    moved = hot_join(found, renamed, ["component"], "left").select("node", F.coalesce("least", "component").alias("component"))
    return stage_table(moved.unionByName(new.join(found.select("node"), "node", "left_anti")), "components")
