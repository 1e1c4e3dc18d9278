"""Near-duplicate documents by SimHash and deletion-variant signatures."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiweave.llm.common import byte_words, small_batches, stored, text_key, unused, with_decision
from epiweave.llm.components import connected_components

SEED = 42
#: Shingles whose bits are counted at once; bounds the memory a very long text takes.
BLOCK = 1 << 16
HALF = 32


def shingle_hashes(words: list[bytes], length: int) -> np.ndarray:
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < length:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(length)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def simhash(text: str | None, length: int) -> int:
    """64 bits, each 1 if set in over half of the shingle hashes; 0 without words. Signed."""
    hashes = shingle_hashes(byte_words(text), length)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        part = hashes[start : start + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def simhash_column(text: str, length: int) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, length) for t in texts], dtype="int64")

    return of(F.col(text))


def near_links(fingerprints: DataFrame, distance: int = 3, hot: int = 1 << 20) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints ``fp`` at up to ``distance`` (at most 3) differing bits.

    Two fingerprints that differ in at most 3 bits differ in at most one bit of one
    of their two 32-bit halves. Half values are therefore indexed by one-wildcard
    variants (one bit deleted): a variant meets at most the two values that differ
    in that bit, whatever the size of a group of copies. Members of equal or
    one-bit-apart half values are joined by equality and verified. Where two
    member lists would give more than ``hot`` comparisons, the members get variants of
    the two 16-bit parts of their other half as well; such a bucket holds at most
    2**17 fingerprints, as only 17 bits are left open.
    """
    if distance > 3:
        raise ValueError("two halves are enough for up to 3 differing bits")
    members = fingerprints.select(
        F.col("fp"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", HALF).alias("v")),
                F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND((1 << HALF) - 1).alias("v")),
            )
        ).alias("half"),
    ).select("half.seg", "half.v", "fp")
    values = members.groupBy("seg", "v").agg(F.count("*").alias("n"))
    equal = values.where("n > 1").select("seg", "v", F.col("v").alias("w"), (F.col("n") * F.col("n")).alias("work"))
    apart = (
        values.select("seg", "v", "n", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1))).alias("bit"))
        .withColumn("rest", F.expr("v & ~shiftleft(1L, bit)"))
        .groupBy("seg", "bit", "rest")
        .agg(F.min(F.struct("v", "n")).alias("x"), F.max(F.struct("v", "n")).alias("y"))
        .where("x.v < y.v")
        .select("seg", F.col("x.v").alias("v"), F.col("y.v").alias("w"), F.expr("x.n * y.n").alias("work"))
    )
    pairs = stored(equal.unionByName(apart))
    near = F.expr(f"bit_count(a ^ b) <= {distance} AND a <> b")

    def sides(of: DataFrame) -> tuple[DataFrame, DataFrame]:
        left = of.join(members, ["seg", "v"]).select("seg", "v", "w", F.col("fp").alias("a"))
        right = of.join(members.withColumnRenamed("v", "w"), ["seg", "w"]).select(
            "seg", "v", "w", F.col("fp").alias("b")
        )
        return left, right

    plain = pairs.where(F.col("work") <= hot).join(members, ["seg", "v"])
    plain = plain.select("seg", "w", F.col("fp").alias("a")).join(
        members.select("seg", F.col("v").alias("w"), F.col("fp").alias("b")), ["seg", "w"]
    )
    found = plain.where(near).select("a", "b")
    left, right = sides(pairs.where(F.col("work") > hot))
    split = _sub_variants(left, "a").join(_sub_variants(right, "b"), ["seg", "v", "w", "sub", "bit", "rest"])
    once = F.expr("bit = 0 OR a_part <> b_part")  # equal parts meet in every variant, one is enough
    return found.unionByName(split.where(once & near).select("a", "b"))


def _sub_variants(side: DataFrame, fp: str) -> DataFrame:
    """One-wildcard variants of the two 16-bit parts of the half that the pair does not fix."""
    other = F.expr(f"CASE seg WHEN 0 THEN {fp} & 4294967295 ELSE shiftrightunsigned({fp}, 32) END")
    return (
        side.withColumn("other", other)
        .select("seg", "v", "w", fp, "other", F.explode(F.array(F.lit(0), F.lit(16))).alias("sub"))
        .withColumn(f"{fp}_part", F.expr("shiftrightunsigned(other, sub) & 65535"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("bit"))
        .select(
            "seg", "v", "w", "sub", "bit", F.expr(f"{fp}_part & ~shiftleft(1L, bit)").alias("rest"), fp, f"{fp}_part"
        )
    )


def near_duplicate_groups(docs: DataFrame, length: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: doc_id, text_key, fp (signed long), component_id.

    Equal fingerprints are one node. ``component_id`` is the smallest doc_id
    reachable over links, null only where no document of the group has an id.
    A null or empty text, or one without words, has fingerprint zero and is linked
    like any other. Repeated rows are documents of their own. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    marked = stored(docs.select("doc_id", text_key().alias("text_key"), simhash_column("text", length).alias("fp")))
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(near_links(nodes.select("fp"), distance))
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("label")
    )
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = stored(labelled.join(smallest, "label").select("fp", "label", "component_id"))
    return marked.join(of_node, "fp")


def one_of_each_group(docs: DataFrame, length: int = 3, distance: int = 3) -> DataFrame:
    """The documents of which one per group stays: the one with the smallest id, nulls last.

    All columns are kept. Of repeated rows one stays.
    """
    grouped = near_duplicate_groups(docs, length, distance)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    kept = grouped.groupBy("label").agg(F.min(first).alias("k")).select("k.doc_id", "k.text_key")
    staying = with_decision(docs, kept, [], "left_semi")
    key = unused(docs, "_key")
    return staying.withColumn(key, text_key()).dropDuplicates(["doc_id", key]).drop(key)
