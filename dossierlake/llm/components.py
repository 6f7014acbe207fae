"""Connected components by alternating large-star and small-star contraction.

Each round rewrites the edges so that every node moves closer to the smallest
node of its component; nothing but a checksum reaches the driver.  A node with
very many neighbours is handled by a combined minimum and a join whose small
side is written first, so that the adaptive skew join can split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize


def _closer(edges: DataFrame, tag: str) -> DataFrame:
    """Replace (u, v), u > v, by (u, m) and (v, m) with m the smallest neighbour of u."""
    least = materialize(edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count("*").alias("c")).where("c > 1").select("k", "m"), tag)
    joined = edges.join(least, F.col("u") == F.col("k"), "left")
    return joined.select(F.explode(F.when(F.col("m").isNull() | (F.col("m") == F.col("v")), F.array(F.struct("u", "v"))).otherwise(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("e")).select("e.u", "e.v")


def _large(edges: DataFrame, tag: str) -> DataFrame:
    """For each u, link its larger neighbours to the smallest node around u."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).where("m < k"), tag)
    # (u, v) with v < u: the larger neighbour of v is u; link it to the smallest around v.
    return edges.join(least, F.col("v") == F.col("k"), "left").select("u", F.coalesce("m", "v").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), the root being the smallest node reachable.

    Loops and repeated edges are allowed; an empty table gives an empty result.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not sign[0] or sign == seen:
            break
        seen = sign
        large = materialize(_large(now, "large"), "edges")
        nxt = materialize(_closer(large, "small").distinct(), "edges")
        discard(now)
        discard(large)
        now = nxt
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
