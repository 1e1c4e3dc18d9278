"""Spelling variants of corpus words, grouped through one-edit neighbourhoods of reduced words."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.llm.common import small_batches, stored

MIN_LENGTH = 7
MIN_COUNT = 2
#: How many times as frequent a form is at least.
FORM_RATIO = 10
#: Every so-many-th run, by its hash, loses a code point.
DROP_EVERY = 31
#: Symbols of the reduced alphabet.
SYMBOLS = 8
_LETTERS = "A-Za-zÀ-ÿ"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(doc_id: int | None, text: str | None, min_length: int = MIN_LENGTH) -> Counter[str]:
    """Words of a text with their occurrences: runs of letters, A-Z lower-cased, some without one code point.

    Which run loses one, and which, comes from the crc32 of ``<doc_id>:<run>`` (no id: ``:<run>``).
    """
    runs = Counter(re.findall(f"[{_LETTERS}]{{{min_length},}}", text.encode().lower().decode()) if text else ())
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found: Counter[str] = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP_EVERY == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < min_length:
                continue
        found[run] += n
    return found


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n) of the words with at least ``min_length`` code points and ``min_count`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                total.update(words_of(doc_id, text, min_length))
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())}
            )

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


# --- reduced words ------------------------------------------------------------


def symbols(words: list[str], count: int) -> np.ndarray:
    """Symbols 1 to ``count`` of words of one length, a row each: a hash of every letter."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return (((letters * _BASE) >> np.uint64(40)) % np.uint64(count) + np.uint64(1)).reshape(len(words), -1)


def _powers(size: int) -> np.ndarray:
    """Weights of the symbols, from the first to the last, in the hash of a reduced word."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))[::-1]


def reduced_keys(words: list[str], count: int) -> np.ndarray:
    """64-bit hash of each reduced word."""
    keys = np.empty(len(words), np.uint64)
    for size, places in _by_length(words):
        keys[places] = symbols([words[i] for i in places], count) @ _powers(size)
    return keys.view(np.int64)


def neighbourhood(words: list[str], count: int, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, hash) of the reduced words one edit from each reduced word, and of itself.

    Edits that give the same reduced word are listed once. Of two reduced words a pair is generated from
    one side only: the longer one deletes what the other would have to insert, and of equally
    long ones the one with the smaller symbol replaces it. Hashes follow from those of what stands before and
    after the edit, so a word of any length takes time in proportion to its neighbourhood.
    """
    owners, hashes = [], []
    for size, places in _by_length(words):
        syms, power = symbols([words[i] for i in places], count), _powers(size)
        terms = syms * power
        own = terms.sum(axis=1, dtype=np.uint64)
        owners.append(places)
        hashes.append(own)
        if size > min_length:
            shorter = np.zeros_like(terms)
            shorter[:, 1:] = np.cumsum(syms[:, :-1] * power[1:], axis=1, dtype=np.uint64)
            rest = np.zeros_like(terms)
            rest[:, :-1] = np.cumsum(terms[:, :0:-1], axis=1, dtype=np.uint64)[:, ::-1]
            new = np.ones(syms.shape, bool)  # the last of equal neighbours stands for all of them
            new[:, :-1] = syms[:, 1:] != syms[:, :-1]
            row, at = np.nonzero(new)
            owners.append(places[row])
            hashes.append((shorter + rest)[row, at])
        for symbol in range(2, count + 1):
            row, at = np.nonzero(syms < symbol)
            owners.append(places[row])
            hashes.append(own[row] + (np.uint64(symbol) - syms[row, at]) * power[at])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(hashes).view(np.int64)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


# --- near words ---------------------------------------------------------------


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, count: int = SYMBOLS) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of ``words`` (word, n) that differ by one inserted, deleted or replaced code point.

    Each pair comes once. Words of which one is an edit away from the other have reduced words that are
    equal or an edit apart; those are found by an equality join of the neighbourhoods with the reduced
    vocabulary, then the words behind them are compared themselves. Nothing is capped: a reduced word
    that many words share is split by adaptive execution.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pa.array(reduced_keys(batch.column("word").to_pylist(), count))
            yield pa.RecordBatch.from_arrays([*batch.columns, key], names=["word", "n", "key"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            owner, other = neighbourhood(batch.column("word").to_pylist(), count, min_length)
            yield pa.RecordBatch.from_arrays([pa.array(key[owner]), pa.array(other)], names=["key", "other"])

    marked = stored(words.mapInArrow(keyed, "word string, n long, key long"))
    reduced = marked.groupBy("key").agg(F.min("word").alias("word"))
    links = reduced.mapInArrow(around, "key long, other long").join(
        reduced.select(F.col("key").alias("other")), "other"
    )
    left = marked.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = marked.select(F.col("key").alias("other"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    apart = F.levenshtein("a", "b", 1) == 1
    once = (F.col("key") != F.col("other")) | (F.col("a") < F.col("b"))
    return links.join(left, "key").join(right, "other").where(once & apart).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the last form reached, by doubling the steps taken.

    A form is at least ten times as frequent, so no chain is long and none is a circle.
    """
    known = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = known.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = stored(
            known.join(further, F.col("root") == F.col("at"), "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            )
        )
        known = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return known


def spelling_variants(docs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n, of equally frequent ones the first in code-point order, if it
    is at least ``ratio`` times as frequent as the word; else null. ``root`` follows the forms to the last
    and is the word itself without a form. Null and empty texts hold no words; repeated rows
    count each; documents without an id are hashed as if their id were empty. Words of any
    length are whole. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    words = stored(vocabulary(docs))
    pairs = near_words(words)
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("less"), F.col("b").alias("near")),
            F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("less"), F.col("a").alias("near")),
        )
    )
    best = pairs.select(both.alias("p")).groupBy("p.word").agg(
        F.count("*").alias("n_near"), F.min(F.struct("p.less", "p.near")).alias("top")
    )
    is_form = -F.col("top.less") >= ratio * F.col("n")
    judged = stored(
        words.join(best, "word", "left").select(
            "word",
            F.when(is_form, F.col("top.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, -F.col("top.less")).alias("form_n"),
        )
    )
    last = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
