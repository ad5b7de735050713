"""Connected components of links between documents, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelnet.llm.storage import dropped, saved

MOST_ROUNDS = 60
#: A node at more than 1 / HUB_SHARE of the links is a hub; there are at most 2 x HUB_SHARE of them, few enough to broadcast.
HUB_SHARE = 512


def _told(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` with the column least of their end a; what hubs have comes by a broadcast, so no task holds all of a hub's edges."""
    hubs = least.filter(F.col("degree") > max(n // HUB_SHARE, 64)).select("a", F.col("least").alias("hub_least"))
    edges = edges.join(F.broadcast(hubs), "a", "left")
    edges = edges.withColumn("key", F.when(F.col("hub_least").isNull(), F.col("a")).otherwise(F.xxhash64("a", "b")))
    edges = edges.join(least.select(F.col("a").alias("key"), "least"), "key", "left")
    return edges.select("a", "b", F.coalesce("hub_least", "least").alias("least"))


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large star and one small star over the ``n`` edges (a > b). A node's least neighbour comes from an aggregate that combines before its shuffle."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("degree")).withColumn("least", F.least("a", "least"))
    large = _told(both.filter("b > a"), least, n).select(F.col("b").alias("a"), F.col("least").alias("b"))
    large = large.unionByName(least.filter("least < a").select("a", F.col("least").alias("b"))).distinct()
    down = large.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("degree"))
    small = _told(large, down, n).select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b")
    return small.unionByName(down.select("a", F.col("least").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every linked node with the least node that links reach from it.

    Links with a null end or from a node to itself count for nothing; an empty table gives an empty one.
    Each round's edges are written to the shared folder; only their count and checksum reach the driver. The number of rounds grows with
    the logarithm of the nodes; if MOST_ROUNDS do not settle it, that is an error, never an unsettled result.
    """
    ends = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = saved(ends.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a > b").distinct())
    was = _state(edges)
    for _ in range(MOST_ROUNDS if was[0] else 0):
        before, edges = edges, saved(_stars(edges, was[0]))
        dropped(before)
        now = _state(edges)
        if now == was:
            break
        was = now
    else:
        if was[0]:
            raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def shared_ids(members: DataFrame, id_col: str, group: str) -> DataFrame:
    """(a, b): links between an id that belongs to several groups and each group's own id; none where every id has one group."""
    some = members.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("b"), F.col(group).alias("a"))
    several = some.groupBy("b").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo < hi")
    return some.join(several.select("b"), "b").filter("a <> b").select("a", "b").distinct()
