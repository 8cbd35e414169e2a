"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligandloom.session import stored

#: The stars halve distances; a chain of n nodes needs about log2(n) rounds, so this is never near.
ROUNDS = 100


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF))).first()
    return tuple(row)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the least node of its component.

    Each round is written to the shared folder, so nothing depends on lost
    executors, and only counts reach the driver. The minimum of a node's
    neighbours combines on the map side; a star's centre, which holds many
    rows, is met in a join that can be split.
    """
    spark = edges.sparkSession
    now = stored(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    if mark[0] == 0:
        return spark.createDataFrame([], "node bigint, root bigint")
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stored(
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large",
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        now = stored(
            large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct(),
            "small",
        )
        before, mark = mark, _mark(now)
        if mark == before:
            roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
