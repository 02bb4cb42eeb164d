"""Connected components of links, by alternating large and small stars: every step is a join, no vertex gathers its neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import stored

#: Rounds after which the stars must have settled: far more than log2 of any graph's size, squared.
MAX_ROUNDS = 200


def components(links: DataFrame) -> DataFrame:
    """vertex, component (the smallest vertex reachable) for every vertex of links (a, b)."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = stored(edges, "graph-edges"), None
    for _ in range(MAX_ROUNDS):
        edges = stored(_small(_large(edges)), "graph-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components haven't settled in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("vertex"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots).groupBy("vertex").agg(F.min("component").alias("component"))


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked with the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    out = both.join(least, both["u"] == least["c"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked with the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
    own = least.select(F.col("c").alias("u"), F.col("m").alias("v"))
    others = edges.join(least, edges["u"] == least["c"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(others).where("u <> v").distinct()
