"""One-permutation MinHash fingerprints, as DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiweave.llm.common import SPACE_CHARS, SPACES, ascii_lower, text_key, text_or_empty

BINS = 256
LOW_BITS = 4
SHINGLE = 5
#: Hashed tries to fill an empty bin before it takes the filled bin that ranks first for it.
TRIES = 16
_BIN_SHIFT = 55  # hashes are cut to 63 bits; the upper 8 say the bin
DOCS_PER_SLICE = 2000
MAX_SLICES = 1 << 14


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the packed fingerprint of a text as ``name``: 16 longs of 16 low-order nibbles, none without words.

    Every shingle of five words (fewer words: all of them) is hashed once; the upper
    bits choose one of 256 bins, which keeps its least hash. An empty bin takes over the value
    of a filled one chosen by hashes of the empty bin's number, the same in all
    documents (optimal densification), hashed with that number, so that values which differ agree
    by chance in each bin on its own. Of each value the four lowest bits are kept.
    """
    lower = F.trim(ascii_lower(text_or_empty(text)), F.lit(SPACE_CHARS))
    words = F.when(lower == "", F.array().cast("array<string>")).otherwise(F.split(lower, SPACES))
    each = ", ".join(f"get(_words, i + {k})" for k in range(SHINGLE))
    shingles = f"""CASE WHEN size(_words) = 0 THEN CAST(array() AS ARRAY<BIGINT>)
        WHEN size(_words) < {SHINGLE} THEN array(xxhash64(_words) & {2**63 - 1})
        ELSE transform(sequence(0, size(_words) - {SHINGLE}), i -> xxhash64({each}) & {2**63 - 1}) END"""
    first = f"""filter(_sorted, (x, i) ->
        i = 0 OR shiftright(x, {_BIN_SHIFT}) <> shiftright(get(_sorted, i - 1), {_BIN_SHIFT}))"""
    none = "CAST(NULL AS BIGINT)"
    bin_of = f"CAST(shiftright({{}}, {_BIN_SHIFT}) AS INT)"
    gap = f"""{bin_of.format("x")} - 1 - IF(i = 0, -1, {bin_of.format("get(_least, i - 1)")})"""
    spread = f"""CASE WHEN size(_least) IN (0, {BINS}) THEN _least ELSE concat(
        flatten(transform(_least, (x, i) -> concat(array_repeat({none}, {gap}), array(x)))),
        array_repeat({none}, {BINS - 1} - {bin_of.format("element_at(_least, -1)")})) END"""
    tries = ", ".join(f"get(_bins, CAST(pmod(xxhash64(i, {t}), {BINS}) AS INT))" for t in range(TRIES))
    ranked = f"array_min(transform(_least, y -> struct(xxhash64(i, shiftright(y, {_BIN_SHIFT}), -1) AS r, y AS y))).y"
    filled = f"transform(_bins, (x, i) -> coalesce(x, xxhash64(coalesce({tries}, {ranked}), i)))"
    nibbles = 64 // LOW_BITS
    packed = f"""CASE WHEN size(_filled) = 0 THEN _filled ELSE transform(sequence(0, {BINS // nibbles - 1}), w ->
        aggregate(slice(_filled, w * {nibbles} + 1, {nibbles}), 0L,
                  (a, x) -> shiftleft(a, {LOW_BITS}) | (x & {2**LOW_BITS - 1}))) END"""
    steps = [("_words", words), ("_hashes", F.expr(shingles)), ("_sorted", F.sort_array("_hashes"))]
    steps += [("_least", F.expr(first)), ("_bins", F.expr(spread)), ("_filled", F.expr(filled)), (name, F.expr(packed))]
    for column, value in steps:
        df = df.withColumn(column, value)
    return df.drop(*(c for c, _ in steps[:-1]))


def printed(fingerprint: str) -> Column:
    """The packed fingerprint as hexadecimal digits, one per bin; empty without words."""
    return F.expr(f"lower(array_join(transform({fingerprint}, x -> lpad(hex(x), 16, '0')), ''))")


def likeness(one: str, other: str) -> Column:
    """Estimated similarity of the shingle sets, 0 to 1.

    Kept bits of different values agree by chance once in 2**LOW_BITS, which the
    estimate takes off. Two texts without words are alike, one without is like no other.
    """
    nibble = "x | shiftright(x, 1) | shiftright(x, 2) | shiftright(x, 3)"
    differing = f"""aggregate(zip_with({one}, {other}, (a, b) -> a ^ b), 0,
        (n, x) -> n + bit_count(({nibble}) & 1229782938247303441L))"""
    chance = 1 / 2**LOW_BITS
    estimate = f"greatest(0D, (1D - {differing} / {BINS}D - {chance}D) / {1 - chance}D)"
    return F.expr(f"""CASE WHEN size({one}) = 0 AND size({other}) = 0 THEN 1D
        WHEN size({one}) = 0 OR size({other}) = 0 THEN 0D ELSE {estimate} END""")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fingerprint (text) of every document."""
    df = docs.select("doc_id", text_key().alias("text_key"), text_or_empty().alias("text"))
    return with_fingerprint(df, "text", "_print").select("doc_id", "text_key", printed("_print").alias("fingerprint"))


def _slice_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of cuts up to an id, found in two steps of about sqrt(cuts) comparisons."""
    if not cuts:
        return F.lit(0)
    step = int(len(cuts) ** 0.5) + 1
    every = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    coarse = F.array(*map(F.lit, cuts[step - 1 :: step])).cast("array<bigint>")
    whole = F.size(F.filter(coarse, lambda c: c <= doc_id)) * step
    return whole + F.size(F.filter(F.slice(every, whole + 1, F.lit(step)), lambda c: c <= doc_id))


def with_next_text(docs: DataFrame, docs_per_slice: int = DOCS_PER_SLICE) -> DataFrame:
    """doc_id, text and ``next``: the text and the fingerprint of the next document by descending doc_id.

    After the last comes the first again; a single document follows itself. Null ids come
    last, repeated ids are ordered by text. Documents are cut into slices of the id range at approximate
    quantiles, so no sort sees the whole table; the first document of the next slice
    follows the last of a slice. Columns: doc_id, text, print, next_text, next_print.
    """
    base = docs.select("doc_id", text_or_empty().alias("text"))
    rows, lowest = base.agg(F.count("*"), F.min("doc_id")).first()
    slices = min(MAX_SLICES, rows // docs_per_slice + 1)
    cuts: list[int] = []
    if slices > 1 and lowest is not None:
        shares = [i / slices for i in range(1, slices)]
        cuts = sorted(set(base.agg(F.percentile_approx("doc_id", shares, 20 * slices)).first()[0]))
    # Slices count downwards: the largest ids are in slice 0.
    place = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.lit(len(cuts)) - _slice_of(F.col("doc_id"), cuts))
    order = [F.col("doc_id").desc_nulls_last(), text_key("text"), F.col("text")]
    placed = with_fingerprint(base.withColumn("slice", place), "text", "print")
    inside = Window.partitionBy("slice").orderBy(*order)
    follower = F.lead(F.struct("text", "print")).over(inside)
    followed = placed.withColumn("next", follower)

    heads = base.withColumn("slice", place).withColumn("at", F.row_number().over(inside)).where("at = 1")
    heads = with_fingerprint(heads, "text", "print").select("slice", F.struct("text", "print").alias("head"))
    used = base.select(place.alias("slice")).distinct()  # one small row per slice
    ring = Window.orderBy("slice")
    after = used.select(
        "slice", F.coalesce(F.lead("slice").over(ring), F.min("slice").over(Window.partitionBy())).alias("after")
    )
    heads = after.join(heads.withColumnRenamed("slice", "after"), "after").select("slice", "head")
    following = F.coalesce("next", "head")
    return followed.join(heads, "slice").select(
        "doc_id", "text", "print", following["text"].alias("next_text"), following["print"].alias("next_print")
    )


def edited_fingerprints(docs: DataFrame, docs_per_slice: int = DOCS_PER_SLICE) -> DataFrame:
    """Fingerprints of every document and of its edited text, with likenesses.

    The edited text has the last third of the code points (rounded down) replaced by the
    first as many, or all, of the next document. Null texts are empty ones. Repeated rows are
    documents of their own; an empty table gives no rows.
    """
    df = with_next_text(docs, docs_per_slice).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut)
    df = df.withColumn("edited", F.concat(kept, F.substring(F.col("next_text"), F.lit(1), cut)))
    df = with_fingerprint(df.drop("text", "next_text"), "edited", "edited_print")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed("print").alias("fingerprint"),
        printed("edited_print").alias("edited_fingerprint"),
        likeness("print", "edited_print").alias("near_edited"),
        likeness("print", "next_print").alias("near_next"),
    )
