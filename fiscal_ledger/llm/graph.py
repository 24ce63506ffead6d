"""Connected components by alternating stars, each step a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscal_ledger.settings import new_table_path


def _table(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


# The smallest neighbours are tables: Spark splits a hot node only where both sides of a join come from a shuffle.


def _large_star(edges: DataFrame, path: str) -> DataFrame:
    """Connect every larger neighbour of u to the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _table(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), f"{path}-large")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, path: str) -> DataFrame:
    """Connect u and its smaller neighbours to the smallest of them; edges have u > v."""
    edges = _table(edges, f"{path}-edges")
    least = _table(edges.groupBy("u").agg(F.min("v").alias("m")), f"{path}-small")
    others = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, or larger ones only: then each component is a star around its smallest."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("smaller"), F.lit(0).alias("larger")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("smaller"), F.lit(1).alias("larger"))
    )
    counts = ends.groupBy("node").agg(F.sum("smaller").alias("smaller"), F.max("larger").alias("larger"))
    return not counts.agg(F.max(F.col("smaller") + F.col("larger") * F.least("smaller", F.lit(1)) > 1)).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on the edges (u, v): the smallest node it is connected to.

    Both kinds of star keep the components. They end with every node connected to the smallest
    alone, after a number of rounds that grows with the logarithm of the nodes. All
    grouping is by minimum, summed before the shuffle, so a node with very many edges is no burden.
    Loops and repeated edges don't matter.
    """
    path = new_table_path(edges.sparkSession, "components")
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, step = _table(ordered, f"{path}/0"), 0
    while not _settled(current):
        step += 1
        to = f"{path}/{step}"
        current = _table(_small_star(_large_star(current, to), to), to)
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
