"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwise.llm.common import cut, dealt_anew


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Each node's neighbours (with `both`, the larger ones; else the smaller ones and itself) are tied to the least of it and its neighbours."""
    if both:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        around = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    least = around.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("least", "n"))
    tied = around.join(dealt_anew(least, "n"), "n")
    if both:
        found = tied.filter("m > n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        found = tied.select(F.col("m").alias("u"), F.col("least").alias("v")).union(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    found = found.filter("u <> v")
    return found if both else found.distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of an edge table (u, v): root is the least node it can reach. Edges may repeat; u = v is ignored.

    Each round halves the distances at least; a round that changes nothing ends
    them. Tables are cut in the checkpoint folder every round.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    if not edges.take(1):
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        edges = cut(_star(_star(edges, True), False))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(
        edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
