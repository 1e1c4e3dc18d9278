"""Mixing of sources to target weights, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiweave.llm.common import SPACE_CHARS, SPACES, stored, text_key, text_or_empty

#: Slices of a source by seeded hash; only the slice in which the quota ends is ordered.
SLICES = 4096


def word_count(text: str = "text") -> Column:
    """Number of words between spaces and the controls 9 to 13."""
    bare = F.trim(text_or_empty(text), F.lit(SPACE_CHARS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACES))).cast("long")


def capped_targets(sources: DataFrame, epochs: int) -> DataFrame:
    """Targets of (source, source_size, weight) that share the sum of all sizes.

    Water-filling: clamping every source that its share lifts over ``epochs`` times its
    size, and sharing the rest by weight again until none is above, ends at the
    level L with sum(min(L * weight, cap)) equal to the sum of all sizes. Sources are
    clamped in the order of cap / weight, so running sums over that order give the
    level after each clamp, and the first that clamps no further source is L. One row per source.
    """
    capped = sources.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.expr("cap / weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levels = capped.withColumn("level", level)
    filled = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)
    return levels.withColumn("filled", filled["level"]).select(
        "source", "source_size", "weight", F.least(F.expr("filled * weight"), F.col("cap").cast("double")).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 9) -> DataFrame:
    """One row per document: doc_id, text_key, source, size, source_size, target, copies, taken.

    Sources, by code point with null last, weigh ``weights`` in turn. A source whose target is
    r times its size gives every document floor(r) whole repetitions, and one more
    (the fractional repetition) to the documents first in a seeded hash order, as many as come
    nearest to the target. That order is never sorted as a whole: sizes summed over
    slices of the hash show the slice in which the quota ends, and only that one is
    ordered. Repeated rows share one fate, so a source can miss its target by half the
    size of a document (and its copies). Reruns agree, in any partitioning.
    Null or empty texts have size 0 and are taken 0 times over; if all sizes are 0, all targets are.
    """
    hashed = F.xxhash64(F.lit(seed), "doc_id", "text_key", "source")
    sizes = stored(
        docs.select("doc_id", text_key().alias("text_key"), "source", word_count().alias("size"))
        .withColumn("h", hashed)
        .withColumn("slice", F.pmod("h", F.lit(SLICES)))
    )
    slices = stored(sizes.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    sources = slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")).withColumn("weight", weight)
    targets = capped_targets(sources, epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    )
    quotas = targets.withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))

    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    placed = slices.withColumn("before", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    q = quotas.withColumnRenamed("source", "_source")
    placed = placed.join(q, placed["source"].eqNullSafe(q["_source"])).select(
        F.col("source").alias("_source"), F.col("slice").alias("_slice"), "source_size", "target", "whole", "quota",
        "before", (F.col("before") + F.col("slice_size")).alias("upto"),
    )
    same = sizes["source"].eqNullSafe(placed["_source"]) & (sizes["slice"] == placed["_slice"])
    rows = sizes.join(placed, same).drop("_source", "_slice")
    ends_here = (F.col("before") < F.col("quota")) & (F.col("quota") < F.col("upto"))
    settled = rows.where(~ends_here).withColumn("more", (F.col("upto") <= F.col("quota")).cast("int"))
    by_hash = Window.partitionBy("source", "slice").orderBy("h").rangeBetween(Window.unboundedPreceding, 0)
    equal = F.sum("size").over(Window.partitionBy("source", "slice", "h"))
    middle = F.col("before") + F.sum("size").over(by_hash) - equal / 2
    ordered = rows.where(ends_here).withColumn("more", (middle <= F.col("quota")).cast("int"))
    copies = (F.col("whole") + F.col("more")).cast("long")
    return settled.unionByName(ordered).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 9) -> DataFrame:
    """The documents the mix takes words of, with all their columns and how many ``copies`` of each.

    Documents without a word are not taken. A column of the documents that is itself named ``copies`` is replaced.
    """
    taken = mix(docs, weights, epochs, seed).where("taken > 0").select(
        F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_text_key"), F.col("source").alias("_source"), "copies"
    )
    taken = taken.distinct()
    same = (
        docs["doc_id"].eqNullSafe(taken["_doc_id"])
        & (text_key(docs["text"]) == taken["_text_key"])
        & docs["source"].eqNullSafe(taken["_source"])
    )
    return docs.join(taken, same).select(*(docs[c] for c in docs.columns if c.lower() != "copies"), taken["copies"])
