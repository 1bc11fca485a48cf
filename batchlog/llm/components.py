"""Connected components by alternating large and small stars.

Edges stay distributed: each round is two aggregates and two joins whose other
side has one row per node, so a node with many edges can be split.  Rounds are
written to the shared folder; their number grows with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import splittable, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = splittable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = splittable(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    up = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return up.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link (a, b); the root is the least node it can reach."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = written(edges, "links"), None
    while True:
        # In a finished forest of stars a round changes nothing.
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if state == before:
            break
        before = state
        edges = written(_small(written(_large(edges), "links")), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
