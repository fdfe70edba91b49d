"""Connected components by joins, for any number of edges; the driver sees counts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsprobe.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """id and root (least id of the component) of every node of the edges (a, b).

    Alternates two steps until no edge changes: every node links its larger neighbours to its least neighbour, and then
    its smaller neighbours to the least of them. A node with very many neighbours is only aggregated and joined, never
    gathered; the number of rounds grows with the logarithm of the component.
    """
    pairs = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        pairs = saved(small.where("a <> b").distinct())
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("root")).union(pairs.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = state
