"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import drop_intermediates, materialise

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge to another: root is the smallest node it reaches.

    Roots themselves have no row. Alternating large-star and small-star steps
    link neighbours to their smallest neighbour until nothing changes: the
    rounds needed grow with the logarithm of the paths' lengths, and the edges
    never grow in number. Every round is written to the shared folder, and
    the round before it removed.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node <> root").distinct()
    edges = materialise(edges, "edges")
    before = _mark(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            return edges
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("least").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("least"))
        small = large.join(least, "node")
        small = small.where("root <> least").select(F.col("root").alias("node"), F.col("least").alias("root")).unionByName(
            least.select("node", F.col("least").alias("root"))
        )
        last = len(common._made) - 1
        edges = materialise(small.distinct(), "edges")
        drop_intermediates(spark, last, keep=1)
        after = _mark(edges)
        if after == before:
            return edges
        before = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
