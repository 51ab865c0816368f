"""Connected components of a graph of any size, by large-star and small-star.

Both steps are joins and minima over the table of edges; each round is written
to the shared folder, and only a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def _stars(edges: DataFrame) -> bool:
    """No node has two parents, or a parent and children: then each component is a
    star around its least node, and another round would change nothing."""
    up = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = edges.select(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    roles = up.unionAll(down).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the least one around the node."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionAll(moved).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) pairs to (id, component_id): the least id that each is tied to.

    Nodes without an edge to another one aren't in the result.  Nulls and edges
    from a node to itself are left out; repeated edges count once.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stored(now, "edges")
    while not _stars(now):
        now = stored(_small_star(_large_star(now)), "edges")
    stars = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return stars.unionAll(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
