"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.llm.staging import stored

HUB_SHARE = 1_000


def _star(directed: DataFrame, smallest_of: DataFrame, limit: float) -> DataFrame:
    """``directed`` with m of its u. Nodes of more than ``limit`` links, of which there are at most 2 * HUB_SHARE, are broadcast; the links of the others
    are shuffled to their node."""
    minima = smallest_of.select(F.col("u").alias("m_u"), "m", "n")
    at = F.col("u") == F.col("m_u")
    hubs = F.broadcast(minima.filter(F.col("n") > limit))
    first = directed.join(hubs, at, "left")
    rest = first.filter("m_u IS NULL").select("u", "v").join(minima.filter(F.col("n") <= limit), at)
    return first.filter("m_u IS NOT NULL").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def large_star(edges: DataFrame, limit: float) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _star(both.filter("v > u"), smallest, limit).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, limit: float) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    below = _star(edges, smallest, limit).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.unionByName(smallest.select("u", F.col("m").alias("v")))


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, component (its smallest node) for every node with a link; links: u, v of one ordered type.

    The steps only move minima, no node's neighbours are gathered: minima of hubs go to the links, links of other nodes to their minimum.
    Every step is written to ``folder``; the number of rounds grows with the logarithm of the links. Nulls and links of a node to itself are left out.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, f"{folder}/edges-0")
    turn, seen = 0, None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen, turn, limit = mark, turn + 1, mark[0] / HUB_SHARE
        large = stored(large_star(edges, limit).distinct(), f"{folder}/large-{turn}")
        edges = stored(small_star(large, limit).distinct(), f"{folder}/edges-{turn}")
