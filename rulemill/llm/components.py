"""Connected components of links between numbers, by alternating star operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


#: Nodes with more than this part of all rows of a join are hubs; there are fewer of them than this number.
_HUBS = 1000


def _joined(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """rows (u, v), n in all, with the m of their u from least (u, m, n).

    A hub's neighbours would come to one task by a join on u. So hubs, whose number is bounded, join by broadcast.
    """
    hubs = least.where(F.col("n") * _HUBS > n).select("u", "m")
    others = least.where(F.col("n") * _HUBS <= n).select("u", "m")
    return rows.join(F.broadcast(hubs), "u").unionByName(rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(others, "u"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Both directions of each edge meet the least of u and its neighbours; larger neighbours move to it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _joined(both, least, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    # each edge points from its larger end (u) to its smaller (v)
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _joined(edges, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of links; component is the least node reachable.

    Links in either direction, repeated links and links of a node to itself are fine; links with a null end count for
    nothing. Rounds are written to the shared folder; their number grows with the logarithm of the size.
    """
    clean = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    clean = materialize(clean, "links")
    alone, edges = clean.where("u = v").select("u"), clean.where("u <> v")
    state = None
    while True:
        # stars are stable when neither step changes the edges: compare their number and a sum of their hashes
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == now:
            break
        state = now
        large = materialize(_large_star(edges, now[0]), "large-stars")
        edges = materialize(_small_star(large, large.count()), "stars")
    # in a star each end has one component and the centre is its own; a link to itself counts where a node has no other
    own = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))
    ends = edges.select(F.explode(own).alias("end")).select("end.*")
    return ends.unionByName(alone.select(F.col("u").alias("node"), F.col("u").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
