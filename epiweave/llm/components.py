"""Connected components of a link table, without collecting links or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b); the component is its smallest node.

    Large-star and small-star steps in turn: every step hangs nodes on the
    smallest neighbour known, so chains shrink by a factor per round. Neighbours
    are never gathered: a step is a grouped minimum, combined before the shuffle,
    and a join back, whose hot nodes adaptive execution splits. Links with a
    null end or to a node itself say nothing and are left out.
    """
    tree = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    digest = _digest(tree)
    while True:
        both = tree.unionByName(tree.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        tree = stored(small.select("e.u", "e.v").where("u <> v").distinct())
        now = _digest(tree)
        if now == digest:
            break
        digest = now
    roots = tree.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return tree.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(tree: DataFrame) -> tuple:
    """Number and order-free hash of the links; equal before and after a round when nothing moved."""
    return tuple(
        tree.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
    )
