"""Search for benchmark passages in documents by spaced-seed hashing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.llm.common import small_batches, stored, text_key

#: Positions that count in a seed (1) and that it ignores (0). Together they hit every run of
#: 13 tokens with up to two substitutions, wherever those are (a test goes through all of them).
MASKS = ("100110111", "111100011", "1000101111")
WINDOW = 13
#: The same for items of fewer tokens: each hits every run of its length with up to a fifth of the
#: tokens (rounded down) substituted. Under 5 tokens that is none.
SHORT_MASKS = {
    5: ("111", "11011"),
    6: ("1111", "110011"),
    7: ("1111", "1110111"),
    8: ("11111", "11100111"),
    9: ("111111", "111000111"),
    10: ("111011", "1101011", "1110011"),
    11: ("1111011", "110001111", "1101100011"),
    12: ("11101011", "11010111", "1110010011"),
}
#: Share of a shorter item's tokens that must agree in the registered query and the pipeline.
SHORT_SIMILARITY = 0.8
#: Bits of the map of test hashes that is sent to the tasks; its size does not grow with the benchmark.
MAP_BITS = 1 << 24
MIN_TOKENS = 1
_CACHE = 1 << 18
_TOKENS = re.compile(r"\w+")
_SEED_TYPES = {
    "hash": pa.int64(), "doc_id": pa.int64(), "text_key": pa.int64(), "place": pa.int32(), "tokens": pa.int32(), "context": pa.binary(),
}
_SEEDS = "hash long, doc_id long, text_key long, place int, tokens int, context binary"


class _TokenHashes(dict):
    """Hash of a token, kept for a bounded number of short tokens."""

    def __missing__(self, token: str) -> int:
        value = xxhash.xxh64_intdigest(token.encode())
        if len(self) < _CACHE and len(token) < 64:
            self[token] = value
        return value


_hashes = _TokenHashes()


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words (runs of letters, digits and underscores)."""
    words = _TOKENS.findall(text.lower()) if text else []
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the counted positions of the mask at every place it fits."""
    places = len(tokens) - len(mask) + 1
    if places < 1:
        return np.empty(0, np.uint64)
    total = np.full(places, xxhash.xxh64_intdigest(mask.encode()), np.uint64)
    for at in (i for i, c in enumerate(mask) if c == "1"):
        odd = np.uint64(xxhash.xxh64_intdigest(f"{mask} {at}".encode()) | 1)
        total += tokens[at : at + places] * odd
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def contexts(tokens: np.ndarray, places: np.ndarray, window: int, outside: int) -> np.ndarray:
    """32-bit token hashes from ``window`` tokens before each place to as many after it."""
    low = (tokens >> np.uint64(32)).astype(np.uint32) | np.uint32(2)
    padded = np.full(len(low) + 2 * window, outside, np.uint32)
    padded[window : window + len(low)] = low
    return padded[places[:, None] + np.arange(2 * window)]


def needed_tokens(tokens: int, similarity: float) -> int:
    """How many of so many aligned tokens must agree."""
    return int(np.ceil(similarity * tokens - 1e-9))


def masks_for(tokens: int, window: int, similarity: float) -> tuple[str, ...]:
    """Masks that find an item; one shorter than a window must agree whole in a share of ``similarity``."""
    if tokens >= window:
        return MASKS
    wrong = tokens - needed_tokens(tokens, similarity)
    if wrong and wrong <= tokens // 5 and tokens in SHORT_MASKS:
        return SHORT_MASKS[tokens]
    return ("1" * max(1, tokens // (wrong + 1)),)  # one of wrong + 1 parts has no substitution


def seeds(
    texts: DataFrame, masks_of: Callable[[int], Iterable[str]], window: int, known: np.ndarray | None,
    once: frozenset[str] = frozenset(),
) -> DataFrame:
    """Seed hits of (doc_id, text_key, text); ``known``: only those whose bit is set in the map.

    ``masks_of`` gives the masks for a text's number of tokens. Of the equal hashes of a mask
    in ``once`` a text keeps the first.
    """
    outside = 1 if known is None else 0  # so that places beyond two ends never agree
    sent = None if known is None else texts.sparkSession.sparkContext.broadcast(known)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sent is None else sent.value
        for batch in batches:
            found: list[tuple] = []
            columns = (batch.column(name).to_pylist() for name in ("doc_id", "text_key", "text"))
            for doc_id, key, text in zip(*columns, strict=True):
                tokens = token_hashes(text)
                if len(tokens) < MIN_TOKENS:
                    continue
                for mask in masks_of(len(tokens)):
                    hashes = seed_hashes(tokens, mask)
                    places = np.arange(len(hashes))
                    if bits is not None:
                        places = np.flatnonzero(in_map(bits, hashes))
                    if mask in once:
                        places = places[np.unique(hashes[places], return_index=True)[1]]
                    if len(places):
                        near = contexts(tokens, places, window, outside)
                        found += [
                            (h, doc_id, key, place, len(tokens), row.tobytes())
                            for h, place, row in zip(hashes[places].view(np.int64).tolist(), places.tolist(), near, strict=True)
                        ]
            if found:
                arrays = zip(zip(*found, strict=True), _SEED_TYPES.items(), strict=True)
                yield pa.RecordBatch.from_pydict({name: pa.array(values, kind) for values, (name, kind) in arrays})

    return texts.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(find, _SEEDS)


def in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether both bits of a hash are set."""
    hit = np.uint64(1)
    for shift in (0, 32):
        slot = (hashes >> np.uint64(shift)) & np.uint64(MAP_BITS - 1)
        hit = hit & (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)))
    return hit.astype(bool)


def hash_map(hashes: DataFrame) -> np.ndarray:
    """Two bits of each hash present, as MAP_BITS / 64 words; an overfull map only lets more hits pass."""
    slots = F.array(*(F.shiftrightunsigned("hash", shift).bitwiseAND(MAP_BITS - 1) for shift in (0, 32)))
    slot = F.col("slot")
    words = (
        hashes.select(F.explode(slots).alias("slot")).select(F.shiftright(slot, 6).cast("int").alias("word"), slot.bitwiseAND(63).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        .collect()
    )
    table = np.zeros(MAP_BITS // 64, np.uint64)
    for word, bits in words:
        table[word] = np.uint64(bits & (1 << 64) - 1)
    return table


def overlaps(
    ours: list[bytes], theirs: list[bytes], width: int, needed: int, window: int, whole: bool = False
) -> np.ndarray:
    """Whether some ``width`` aligned tokens around the hit agree in ``needed`` places at least.

    ``whole``: only tokens that lie inside both texts count as aligned.
    """
    a, b = (np.frombuffer(b"".join(x), np.uint32).reshape(-1, 2 * window) for x in (ours, theirs))
    enough = _in_runs(a == b, width) >= needed
    if whole:
        enough &= _in_runs((a > 1) & (b > 1), width) == width
    return enough.any(axis=1)


def _in_runs(marks: np.ndarray, width: int) -> np.ndarray:
    """Number of marks in every run of ``width`` columns."""
    total = np.cumsum(marks, axis=1)
    total = np.concatenate([np.zeros((len(marks), 1), total.dtype), total], axis=1)
    return total[:, width:] - total[:, : marks.shape[1] - width + 1]


def benchmark_hits(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = 0.8, short_similarity: float = SHORT_SIMILARITY
) -> DataFrame:
    """(doc_id, text_key, item_id) of documents that hold a passage of a test item.

    A passage is a run of ``window`` aligned tokens of which a share of ``similarity`` agrees
    (a shorter item: all of its tokens, ``short_similarity``), so words may be substituted but not
    inserted. Hashes of masks that ignore some positions are joined between test items and
    documents, and the tokens around each joint hit are compared. Hashes of documents that
    no test item has are mostly dropped where they are made, by a bit map of fixed size;
    the join is exact. Items without a token, null or empty ones, cannot be found.
    An item without an id goes by the key of its text, here and in the result.
    """
    small_batches(docs.sparkSession)
    item = F.coalesce(F.col("item_id").cast("long"), text_key())
    tests = items.select(item.alias("doc_id"), text_key().alias("text_key"), "text")
    tests = stored(seeds(tests, lambda n: masks_for(n, window, short_similarity), window, None))
    short = sorted(r[0] for r in tests.where(F.col("tokens") < window).select("tokens").distinct().collect())
    by_length = {n: masks_for(n, window, short_similarity) for n in short}  # fewer than ``window`` lengths
    masks = tuple(dict.fromkeys([*MASKS, *(m for of in by_length.values() for m in of)]))
    parts = {m for n, of in by_length.items() for m in of if len(m) < n}
    # A hit of a mask that is only ever a whole item, every token counted, is the passage itself.
    once = frozenset("1" * n for n in short) - parts
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    found = seeds(keyed, lambda _: masks, window, hash_map(tests), once)
    theirs = tests.select(
        "hash", F.col("doc_id").alias("item_id"), F.col("context").alias("item_context"),
        F.least("tokens", F.lit(window)).alias("width"),
    )

    @F.pandas_udf("boolean")
    def overlap(a: pd.Series, b: pd.Series, widths: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for width in widths.unique():
            at = np.flatnonzero(widths == width)
            needed = needed_tokens(int(width), similarity if width == window else short_similarity)
            out[at] = overlaps(list(a.iloc[at]), list(b.iloc[at]), int(width), needed, window, bool(width < window))
        return pd.Series(out)

    hits = found.join(theirs, "hash").where(overlap("context", "item_context", "width"))
    return hits.select("doc_id", "text_key", "item_id").distinct()


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = 0.8, short_similarity: float = SHORT_SIMILARITY
) -> DataFrame:
    """One row per document: doc_id, text_key, n_items (test items it holds passages of), contaminated.

    Null and empty texts hold none; repeated rows are judged alike; an empty benchmark
    leaves every document clean.
    """
    hits = benchmark_hits(docs, items, window, similarity, short_similarity)
    held = hits.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    held = held.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_key"), "n")
    keyed = docs.select("doc_id", text_key().alias("text_key"))
    same = keyed["doc_id"].eqNullSafe(held["_doc_id"]) & (keyed["text_key"] == held["_key"])
    n = F.coalesce("n", F.lit(0))
    return keyed.join(held, same, "left").select(
        "doc_id", "text_key", n.alias("n_items"), (n > 0).alias("contaminated")
    )


def clean_documents(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, similarity: float = 0.8, short_similarity: float = SHORT_SIMILARITY
) -> DataFrame:
    """The documents without passages of test items, with all their columns."""
    hits = benchmark_hits(docs, items, window, similarity, short_similarity)
    held = hits.select("doc_id", "text_key").distinct()
    held = held.select(F.col("doc_id").alias("_doc_id"), F.col("text_key").alias("_key"))
    same = docs["doc_id"].eqNullSafe(held["_doc_id"]) & (text_key(docs["text"]) == held["_key"])
    return docs.join(held, same, "left_anti")
