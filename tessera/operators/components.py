"""Connected components of an edge table that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.staging import discard, stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the least node id reached.

    Alternates large-star and small-star steps until the edges stand still, which takes a number of rounds
    logarithmic in the longest path.  No vertex gathers its neighbours into one row: a step only needs the
    least neighbour per node, so a hub costs one aggregated value.  Each round is staged.

    Null end points are ignored, self loops keep their node, repeated edges count once, an empty table gives
    an empty result.  Node ids may be of any orderable type.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = e.select("u").union(e.select("v")).distinct()
    e = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stage(e, "cc")
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the smaller neighbours of u, and u itself, go to the least of them
        large = stage(large.where("u <> v").distinct(), "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        before_it, e = e, stage(small, "cc")
        discard(before_it, large)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.withColumnRenamed("u", "node").join(e.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
