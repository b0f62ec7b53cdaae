"""Connected components of a graph of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.plans.staging import stage, unstage


def _downward(a, b, edges: DataFrame) -> DataFrame:
    """Distinct links (v, u) with u < v."""
    return edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).filter("v != u").distinct()


def star_edges(members: DataFrame, node: str, hub: str) -> DataFrame:
    """(a, b): links that connect what the rows (node, hub) connect, one for each node and few among hubs.

    A node's links to several hubs become one to its least hub and one from each other
    hub to that, which nodes with the same hubs share.  ``hub`` is at most ``node``, and a
    node has a bounded number of hubs.
    """
    own = members.filter(F.col(node) != F.col(hub)).groupBy(node).agg(F.collect_set(hub).alias("_hubs")).select(F.col(node).alias("_node"), F.array_min("_hubs").alias("b"), "_hubs")
    return own.select(F.explode(F.array_append("_hubs", F.col("_node"))).alias("a"), "b").filter("a != b").distinct()


def connected_components(edges: DataFrame, tag: str = "cc", rows: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long) that has a link: the least node reachable.

    Links lead from a node to a lesser one.  A round alternates two steps: a link to a node
    that has lesser ones goes to its least instead (large star), and the links of a node
    move down to its least one (small star).  Either keeps what is connected, never makes
    more links, and merges those that become equal, so that a dense group soon has one
    link a node.  It ends when every link goes to a root and every node has one.  Links
    are staged tables; the joins shuffle plainly, so Spark can split a node with very
    many links.  ``rows`` is about how many links there are at most, for the size of files.
    """
    links = stage(_downward(F.col("a"), F.col("b"), edges), f"{tag}-links", rows=rows)
    rows = links.count()  # a round makes no more
    while True:
        least = links.groupBy(F.col("v").alias("u")).agg(F.min("u").alias("low"))
        large = stage(_downward(F.col("v"), F.coalesce("low", "u"), links.join(least, "u", "left")), f"{tag}-large", rows=rows)
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(least, "v").select(F.when(F.col("u") == F.col("low"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("low").alias("u"))
        before, links = links, stage(small.distinct(), f"{tag}-small", rows=rows)
        unstage(before, large)
        above = links.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("u"))
        if above.filter("n > 1").isEmpty() and links.select("u").distinct().join(links.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    roots = links.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    labels = stage(links.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(roots), f"{tag}-labels", rows=2 * rows)
    unstage(links)
    return labels
