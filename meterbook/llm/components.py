"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm.workspace import release, scratch, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    with scratch() as own:
        least = own.stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        return stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these."""
    with scratch() as own:
        least = own.stored(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
        tied = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return stored(tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b); loops are ignored. A stored table."""
    pair = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = stored(pair, "edges")
    digest = None
    while True:
        larger = _large_star(edges)
        release(edges)
        edges = _small_star(larger)
        release(larger)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == digest:
            found = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), "components")
            release(edges)
            return found
        digest = now
