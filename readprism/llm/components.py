"""Connected components of an edge table, by alternating large and small stars.

Every round is two joins of the edges with the least neighbour of each node.
Only that minimum is aggregated; of a node with very many neighbours, Spark may
split the join's rows over several tasks. Each round's edges are written to the
shared folder. The result is a star for each component: all its nodes point to
its least node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readprism.llm.shared import Scratch, apart


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): the edges and the least of u and its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, apart(F.col("u")) == apart(F.col("w"))).drop("w")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Of edges with u > v: v joins the least neighbour of u, and u keeps the edge to it."""
    return _with_least(edges).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: numbers) that is not itself a root."""
    state = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hashes")
    now, seen = scratch.measured(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", state)
    while seen.n:
        last = seen
        now, seen = scratch.measured(_small_star(_large_star(now)), "edges", state)
        if last == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
