"""Links within runs of rows that share a key, where a run may hold any share of all rows.

A run that fits a task is compared there. A longer one is linked in two passes, so that a large group of near copies
doesn't cost the square of its size. First each of its rows meets a few pivots of the run, in tasks of a bounded size.
Those links, with all of the short runs, give components. Rows that lie in the run's largest component need not meet
one another: what is left of a run meets the whole of it, chunk by chunk. No link between two components is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: Rows of a long run that all others of it meet first, and the load of a row that has no other: a chunk of n rows
#: has room for n of these.
PIVOTS, UNIT = 16, 1024


def _own(node: str, count: str) -> Column:
    return F.pmod(F.xxhash64(node), count)


def _upto(count: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)


def _place(c: Column, d: Column, side: Column | int) -> Column:
    side = F.lit(side) if isinstance(side, int) else side
    return F.struct(c.alias("c"), d.alias("d"), side.cast("long").alias("side"))


def _stars(short: DataFrame, long: DataFrame | None, key: Sequence[str], node: str, pivots: int) -> DataFrame:
    """Places of short runs, of each row of a run with n chunks (its own, side 1) and of its pivots (all, side 0)."""
    one = F.lit(0).cast("long")
    alone = short.select(*key, node, F.array(_place(one, one, 0)).alias("places"))
    if long is None:
        return alone
    drawn = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(1), node), node)
    some = long.withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= pivots).drop("_r")
    every = F.transform(_upto("n"), lambda i: _place(i, i, 0))
    rows = long.select(*key, node, F.array(_place(_own(node, "n"), _own(node, "n"), 1)).alias("places"))
    return alone.unionByName(rows).unionByName(some.select(*key, node, every.alias("places")))


def _rest(long: DataFrame, found: DataFrame, key: Sequence[str], node: str, chunk: int) -> DataFrame:
    """Places of rows outside the largest component of their run, and of that component.

    Chunk i of the rest meets its chunk j in the task (smaller, larger), and chunk j of the component in (i, -1 - j).
    """
    named = long.join(found.withColumnRenamed("node", node), node, "left").withColumn("component", F.coalesce("component", node))
    load = F.col("load") if "load" in long.columns else F.lit(UNIT)
    named = materialize(named.select(*key, node, "n", "component", load.cast("long").alias("load")), "long-runs")
    sizes = named.groupBy(*key, "component").agg(F.count("*").alias("size"), F.sum("load").alias("load"))
    most = sizes.groupBy(*key).agg(F.max(F.struct("size", "component", "load")).alias("most"), F.sum("load").alias("all"))
    left = most.select(*key, F.col("most.component").alias("main"), F.ceil((F.col("all") - F.col("most.load")) / (chunk * UNIT)).cast("long").alias("g")).where("g > 0")
    own = F.col("own")
    among = F.transform(_upto("g"), lambda w: _place(F.least(own, w), F.greatest(own, w), own > w))
    across = F.transform(_upto("n"), lambda w: _place(own, -1 - w, 0))
    met = F.transform(_upto("g"), lambda i: _place(i, -1 - own, 1))
    rows = named.drop("load").join(left, list(key)).withColumn("own", F.when(F.col("component") == F.col("main"), _own(node, "n")).otherwise(_own(node, "g")))
    return rows.select(*key, node, F.when(F.col("component") == F.col("main"), met).otherwise(F.concat(among, across)).alias("places"))


def _at(rows: DataFrame) -> DataFrame:
    """A row for each of its places (c, d, side)."""
    return rows.withColumn("place", F.explode("places")).select(*[c for c in rows.columns if c != "places"], "place.*")


def run_links(short: DataFrame, long: DataFrame, key: Sequence[str], node: str, link: Callable[[DataFrame], DataFrame], chunk: int, attach: Callable[[DataFrame], DataFrame] = lambda rows: rows, pivots: int = PIVOTS) -> DataFrame:
    """Links (a, b) that connect all rows of a run that are linked at all, by way of rows of any run.

    short: (key, node) of runs of one chunk; long: (key, node, n) of runs of n chunks, with the load of each row if rows
    differ (a chunk has room for chunk * UNIT). attach joins what link needs to
    rows (key, node, places), before they are copied to their places, so that no node is a hot key. link takes rows
    (key, node, c, d, side), compares those of equal (key, c, d), across the sides where there are two, and returns
    links (a, b).
    """
    if long.isEmpty():
        return link(_at(attach(_stars(short, None, key, node, pivots))))
    long = materialize(long.select(*key, node, "n", *[c for c in ("load",) if c in long.columns]), "long-runs")
    first = materialize(link(_at(attach(_stars(short, long, key, node, pivots)))), "first-links")
    return first.unionByName(link(_at(attach(_rest(long, connected_components(first), key, node, chunk)))))
