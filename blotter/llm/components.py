"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations and two joins over the edges; its result is
written to the shared folder, which cuts the lineage.  The number of rounds is
about the logarithm of the longest chain; they end when each component is a star around its
smallest node.  Hubs are joined by broadcast (``common.lookup``).  Two numbers a round and the
few hubs come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.llm.common import lookup, written


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return lookup(both.filter("v > u"), least, ["u"], rows=n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = lookup(down, least, ["u"], rows=n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _stars(edges: DataFrame) -> tuple[bool, int]:
    """Whether every link goes from a node that has only this one to a node that has none, and the number of links."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")),
                                          F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.out").alias("out"), F.max("e.in").alias("in"))
    got = nodes.agg(F.count_if((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))), F.coalesce(F.sum("out"), F.lit(0))).first()
    return got[0] == 0, got[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v long): root is the smallest node that it is connected to."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = written(down.filter("u <> v").distinct(), "cc-edges")
    done, n = _stars(edges)
    while not done:
        starred = written(_large_star(edges, n), "cc-large")
        edges = written(_small_star(starred, n), "cc-small")
        done, n = _stars(edges)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
