"""Connected components of a table of links by large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, join_spread, written

#: Links from which on those of one node are dealt out in joins; fewer fit a task.
MANY = 1_000_000


def _with(links: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    """links (u, v) with the m of their u; least: (u, m, n), n the links of u."""
    return join_spread(links, least, ["u"], "n", "v") if many else links.join(least, "u")


def _large_star(e: DataFrame, many: bool) -> DataFrame:
    """Joins each node's larger neighbours to its least one."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _with(both, least, many).filter((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, many: bool) -> DataFrame:
    """Joins each node and its smaller neighbours to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with(down, least, many).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of links (a, b) with a link to another; component: the least id reachable.

    Links in any direction, repeated or to the node itself are fine; without links there are no rows. Each round is two shuffles of the links, written to
    the shared folder; the rounds grow with the logarithm of the longest path. Of a node with many
    neighbours each task gets a part.
    """
    links = links.filter("a != b").select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = mark(edges)
    while now[0]:
        many = now[0] > MANY
        new = written(_small_star(_large_star(edges, many), many))
        drop_written(edges)
        edges, last, now = new, now, mark(new)
        if now == last:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
