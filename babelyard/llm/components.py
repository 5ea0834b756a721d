"""Connected components of a link table, by alternating stars; nothing of the graph reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelyard.llm.tables import materialise, materialise_counted, spread_join


def _beside_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with the least v of their u as m, and u, m, n of every u."""
    found = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    least, seen = materialise_counted(found, "components-least", total=F.sum("n"))
    return spread_join(edges, least.select("u", "m"), "u", "v", counts=least.select("u", "n"), total=seen["total"] or 0), least


def _large_star(edges: DataFrame) -> DataFrame:
    own, _ = _beside_least(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    return own.where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    own, least = _beside_least(materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "components-down"))
    return own.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, root of every node that has a link to another; root is the component's least node.

    Each round makes every node's greater neighbours point at its least neighbour, then the same
    for its lesser ones; components become stars in a number of rounds that grows with the logarithm of the graph.
    A node with very many links is a key of partial minima, which Spark combines before it deals them, and of joins, where
    its links are dealt over many parts (spread_join).
    Links are counted once whatever their direction; null ends and links of a node to itself don't count.
    """
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = materialise(edges.distinct(), "components")
    seen = None
    for _ in range(most_rounds):
        stars = _small_star(_large_star(edges)).where("u <> v").distinct()
        edges, state = materialise_counted(stars, "components", n=F.count("*"), sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
