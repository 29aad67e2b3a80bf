"""Connected components of a graph that is held in tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderline.llm.common import materialise


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node reachable from it, for every node of an edge (a, b).

    Alternates two moves until nothing changes: every node ties its larger neighbours to its smallest
    neighbour, then its smaller ones and itself. Each move keeps what is connected, never adds an
    edge, and halves the distances. Every round is written to the shared folder. Loops and repeated
    edges do no harm; nulls and an empty table give nothing. RuntimeError if the rounds do not suffice,
    of which some need the logarithm of the longest path.
    """
    now = materialise(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("v < u").distinct())

    def tie(pairs: DataFrame, both: bool) -> DataFrame:
        """pairs (u, v). both: from larger neighbours to the smallest; else from u's smaller neighbours."""
        sides = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else pairs
        least = materialise(sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))  # written, so that the join can split a node of many neighbours
        joined = sides.join(least, "u")
        if both:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        return joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()

    before = None
    for _ in range(most_rounds):
        now = materialise(tie(tie(now, True), False))
        # Unchanged pairs have an unchanged checksum; it adds up over all rows without order.
        sign = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
