"""Connected parts of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ligandloom.session import discard, stored


def _below(pairs: DataFrame) -> DataFrame:
    """Per x its least partner, or x itself."""
    return pairs.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))


def _round(edges: DataFrame) -> DataFrame:
    """All partners above a node, then all below it, are hung under its least one."""
    both = edges.union(edges.select("y", "x"))
    hung = both.join(_below(both), "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
    joined = hung.join(_below(hung), "x")
    moved = joined.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return moved.union(joined.select("x", F.col("m").alias("y"))).distinct()


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node named in ``links``; root is the least node of its part. A row may link a node to itself.

    Rounds halve the chains, and end when one changes nothing. Each is written to the shared folder and the one before
    deleted; least partners combine on the map side, and a hub is met in joins that can be split. Only a count and a checksum
    come to the driver.
    """
    named = links.select(F.col(a).alias("node")).union(links.select(F.col(b).alias("node"))).where("node is not null").distinct()
    named = stored(named, "nodes")
    edges = stored(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct(), "links"
    )
    mark = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").bitwiseAND(0xFFFFFFFF))).first())
        if now == mark or now[0] == 0:
            break
        before, edges, mark = edges, stored(_round(edges), "links"), now
        discard(before)
    roots = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return named.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
