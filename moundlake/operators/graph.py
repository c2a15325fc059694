"""Connected components of an edge table, as a DataFrame loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moundlake.runtime import cut_lineage


def connected_components(edges: DataFrame, group: str = "survey_id") -> DataFrame:
    """``(group, node, root)``: root is the least node of the component.

    Alternates the large-star and small-star steps, which need about log(n)
    rounds. Minima are algebraic aggregates, so a hub node is combined map-side;
    each round is written out and the loop stops when the edge set is unchanged,
    which it reaches: every round that changes an edge lowers an end of it.
    """
    pairs = edges.select(group, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = cut_lineage(pairs)
    before = None
    while True:
        both = pairs.select(group, "u", "v").union(pairs.select(group, F.col("v"), F.col("u")))
        least = both.groupBy(group, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour of u hangs under the least neighbour of u
        large = (
            both.join(least, [group, "u"])
            .where("v > u and v <> m")
            .select(group, F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small star: u and its smaller neighbours hang under the least of them
        lowest = large.groupBy(group, "u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, [group, "u"])
            .select(group, F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        pairs = cut_lineage(small)
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(group, "u", "v"))).first()
        if state == before:
            break
        before = state
    roots = pairs.select(group, F.col("v").alias("node"), F.col("v").alias("root"))
    members = pairs.select(group, F.col("u").alias("node"), F.col("v").alias("root"))
    lone = edges.where("a = b").select(group, F.col("a").alias("node"), F.col("a").alias("root"))
    return members.union(roots).union(lone).groupBy(group, "node").agg(F.min("root").alias("root"))
