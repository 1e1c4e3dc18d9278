"""Language-model scores of texts by context-tree weighting over bytes."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epiweave.llm.chunks import CHUNK_BYTES, Packer, key_totals, looked_up, packed, scratch
from epiweave.llm.common import byte_words, small_batches, stored, text_key

#: Bytes of a context, and how many a code has room for.
DEPTH, MOST_DEPTH = 5, 6
#: Bytes of forms whose codes are worked on at once.
PART_BYTES = 2 << 20
SPACE, END = 0x20, 0x0A
#: The token that ends a text; no word holds its byte.
END_TOKEN = bytes([END])
SMOOTHING = 0.1
_LN10 = math.log(10)


def training(doc_id: str = "doc_id", folds: int = 10) -> Column:
    """Whether a document is learnt from: its id as text has a crc32 that ``folds`` does not divide."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds != 0, F.lit(False))


# --- tokens of documents ------------------------------------------------------


class _Tokens(Packer):
    """Distinct tokens of each document, named by their place in the chunk's vocabulary."""

    key = pa.binary()
    fields = [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("learn", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("places", pa.binary()),
        ("times", pa.binary()),
    ]

    def start(self) -> None:
        self.place: dict[bytes, int] = defaultdict(lambda: len(self.place))
        self.learnt: list[np.ndarray] = []

    def add(self, batch: pa.RecordBatch) -> list[pa.Array]:
        sizes, places, times = [], [], []
        place = self.place.__getitem__
        for text, learn in zip(batch.column("text").to_pylist(), batch.column("learn").to_pylist(), strict=True):
            ids = np.fromiter(map(place, [*byte_words(text), END_TOKEN]), np.int32)
            if learn:
                self.learnt.append(ids)
            which, often = np.unique(ids, return_counts=True)
            sizes.append(len(ids))
            places.append(which.tobytes())
            times.append(often.astype(np.int32).tobytes())
        self.learnt = [np.concatenate(self.learnt)] if self.learnt else []
        given = [batch.column(name) for name in ("doc_id", "text_key", "learn")]
        return [*given, pa.array(sizes, pa.int64()), pa.array(places, pa.binary()), pa.array(times, pa.binary())]

    def keys(self) -> tuple[pa.Array, pa.Array]:
        learnt = self.learnt[0] if self.learnt else np.empty(0, np.int32)
        counts = np.bincount(learnt, minlength=len(self.place)).astype(np.int64)
        return pa.array(list(self.place), pa.binary()), pa.array(counts, pa.int64())


# --- contexts of texts --------------------------------------------------------


def form(text: str | None) -> bytes:
    """What the model reads of a text: its words, each followed by a space, then the end."""
    return b"".join(word + b" " for word in byte_words(text)) + END_TOKEN


def grams(forms: list[bytes], depth: int) -> np.ndarray:
    """Codes of every (context, next byte) of the forms, in order: one for each of their bytes.

    A context is the ``depth`` bytes before, whatever words they belong to; before a form's first
    byte stand spaces. A code is the context's bytes from the oldest to the newest, then the next byte.
    """
    before = bytes([SPACE]) * depth
    data = b"".join(before + f for f in forms)
    size = len(data) - depth
    data += bytes(8)
    codes = np.empty(size, np.int64)
    for offset in range(8):
        part = codes[offset::8]
        eight = np.frombuffer(data, ">u8", len(part), offset)
        part[:] = eight >> np.uint64(64 - 8 * (depth + 1))
    # no byte of a form comes next in the codes that begin in the last bytes of the form before
    ends = np.cumsum([depth + len(f) for f in forms])[:-1]
    own = np.ones(size, bool)
    own[(ends[:, None] - np.arange(1, depth + 1)).ravel()] = False
    return codes[own]


def _parts(forms: list[bytes], depth: int) -> Iterator[np.ndarray]:
    """``grams`` of the forms, a bounded number of codes at a time."""
    some, filled = [], 0
    for f in forms:
        if len(f) > PART_BYTES:
            if some:
                yield grams(some, depth)
            some, filled = [], 0
            yield grams([f[:PART_BYTES]], depth)
            for at in range(PART_BYTES, len(f), PART_BYTES):
                yield grams([f[at - depth : at + PART_BYTES]], depth)[depth:]
            continue
        some.append(f)
        filled += len(f)
        if filled >= PART_BYTES:
            yield grams(some, depth)
            some, filled = [], 0
    if some:
        yield grams(some, depth)


class _Contexts(Packer):
    """Forms of documents, with the distinct codes of the chunk and how often its learnt documents hold them."""

    key = pa.int64()
    fields = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("form", pa.binary())]

    def __init__(self, depth: int):
        self.depth = depth

    def start(self) -> None:
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def size(self, batch: pa.RecordBatch) -> int:
        return batch.column("text").nbytes // 2  # most codes of a chunk are in the next one too

    def add(self, batch: pa.RecordBatch) -> list[pa.Array]:
        forms = [form(t) for t in batch.column("text").to_pylist()]
        learn = batch.column("learn").to_pylist()
        for wanted in (True, False):
            for codes in _parts([f for f, ok in zip(forms, learn, strict=True) if ok == wanted], self.depth):
                distinct, n = np.unique(codes, return_counts=True)
                self.codes.append(distinct)
                self.counts.append(n if wanted else np.zeros(len(n), np.int64))
        if len(self.codes) > 16:
            self._together()
        return [batch.column("doc_id"), batch.column("text_key"), pa.array(forms, pa.binary())]

    def _together(self) -> None:
        if self.codes:
            codes = np.concatenate(self.codes)
            order = np.argsort(codes, kind="stable")
            codes = codes[order]
            first = np.flatnonzero(np.diff(codes, prepend=codes[0] - 1))
            self.counts = [np.add.reduceat(np.concatenate(self.counts)[order], first)]
            self.codes = [codes[first]]

    def keys(self) -> tuple[pa.Array, pa.Array]:
        self._together()
        codes, counts = (self.codes[0], self.counts[0]) if self.codes else (np.empty(0, np.int64),) * 2
        return pa.array(codes, pa.int64()), pa.array(counts, pa.int64())


class _Places:
    """Places of codes among sorted distinct ones that hold them all."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.shift = np.uint64(64 - max(len(codes), 1).bit_length() - 2)
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self._slot(codes)] = np.arange(len(codes), dtype=np.int32)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """A slot has the place of the last code that fell there; the others are searched for."""
        places = self.slots[self._slot(codes)]
        other = np.flatnonzero(self.codes[places] != codes)
        places[other] = np.searchsorted(self.codes, codes[other])
        return places


# --- the tree -----------------------------------------------------------------


def _log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5: Stirling's series at x + 8, carried back."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    factors = x
    for i in range(1, 8):
        factors = factors * (x + i)
    return series + 1 / (1260 * y * y * y * y * y) - F.log(factors)


def _kt(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _parent(size: int) -> Column:
    """The context without its oldest byte, of one that has ``size`` bytes."""
    return F.col("ctx").bitwiseAND((1 << (8 * (size - 1))) - 1)


def _decisions(codes: DataFrame, *more: Column) -> DataFrame:
    """Codes (up, ctx, key, n), eight times each: the bits before a decision (``prefix``), and n by what it was."""
    j = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")
    bit = F.expr("shiftright(key & 255, 7 - j) & 1")
    prefix = F.expr("CAST(shiftright((key & 255) | 256, 8 - j) AS INT)").alias("prefix")
    return codes.select("*", j).select(
        "up", "ctx", "key", prefix, bit.alias("bit"), *more,
        F.when(bit == 0, F.col("n")).otherwise(F.lit(0)).alias("zeros"),
        F.when(bit == 1, F.col("n")).otherwise(F.lit(0)).alias("ones"),
    )


def code_lengths(counts: DataFrame, depth: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(key, lp): ln of the probability of each code's byte after its context, from the codes' counts.

    ``counts`` has each code once; codes that were never learnt have n = 0. Bytes are eight binary
    decisions; every context has a node per decision. Going up, a node's weighted probability
    is the mean of its own Krichevsky-Trofimov estimate and the product of its children's weighted ones; going
    down, these weights mix the estimates of all depths. A level of the tree is one grouped sum
    or one join, whatever the number of contexts. ``keep`` writes a level and reads it back.

    The longest contexts have most of the nodes. Their codes are shuffled by the context above (at most
    65,536 codes have the same) before they become decisions, and these not again.
    """
    codes = counts.withColumn("ctx", F.shiftright("key", 8)).withColumn("up", _parent(depth)).repartition("up")
    sums = [F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")]
    deepest = _decisions(codes).groupBy("up", "ctx", "prefix").agg(*sums)
    above = (
        deepest.withColumn("lw", _kt(F.col("zeros"), F.col("ones")))
        .groupBy(F.col("up").alias("ctx"), "prefix")
        .agg(*sums, F.sum("lw").alias("children"))
    )
    levels: list[DataFrame] = []
    for size in range(depth - 1, -1, -1):
        nodes = keep(above.withColumn("kt", _kt(F.col("zeros"), F.col("ones"))), f"up-{size}")
        levels.insert(0, nodes)
        if size:
            top = F.greatest("kt", "children")
            mean = top + F.log(0.5 * F.exp(F.col("kt") - top) + 0.5 * F.exp(F.col("children") - top))
            above = (
                nodes.select(_parent(size).alias("ctx"), "prefix", "zeros", "ones", mean.alias("lw"))
                .groupBy("ctx", "prefix")
                .agg(*sums, F.sum("lw").alias("children"))
            )
    total = F.col("zeros") + F.col("ones") + 1.0
    p0, p1 = (F.col("zeros") + 0.5) / total, (F.col("ones") + 0.5) / total
    path = None
    for size, nodes in enumerate(levels):
        if path is None:
            nodes = nodes.withColumn("m0", F.lit(0.0)).withColumn("m1", F.lit(0.0)).withColumn("rest", F.lit(1.0))
        else:
            keyed = path.withColumnRenamed("ctx", "up")
            nodes = nodes.withColumn("up", _parent(size)).join(keyed, ["up", "prefix"])
        here = 1 / (1 + F.exp(F.col("children") - F.col("kt")))
        below = 1 / (1 + F.exp(F.col("kt") - F.col("children")))
        mixed = nodes.select(
            "ctx", "prefix",
            (F.col("m0") + F.col("rest") * here * p0).alias("m0"),
            (F.col("m1") + F.col("rest") * here * p1).alias("m1"),
            (F.col("rest") * below).alias("rest"),
        )
        path = keep(mixed, f"down-{size}")
    # a context's nodes as one row: at most 255
    entry = F.struct("prefix", F.struct("m0", "m1", "rest"))
    paths = path.groupBy(F.col("ctx").alias("up")).agg(F.map_from_entries(F.collect_list(entry)).alias("path"))
    at = F.expr("path[CAST(shiftright((key & 255) | 256, 8 - j) AS INT)]").alias("above")
    node = Window.partitionBy("up", "ctx", "prefix")
    steps = _decisions(codes.join(paths, "up"), at).withColumns(
        {"zeros": F.sum("zeros").over(node), "ones": F.sum("ones").over(node)}
    )
    p = F.when(F.col("bit") == 1, F.col("above.m1") + F.col("above.rest") * p1)
    p = p.otherwise(F.col("above.m0") + F.col("above.rest") * p0)
    return keep(steps.groupBy("key").agg(F.sum(F.log(p)).alias("lp")), "lengths")


def _byte_scores(depth: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        places, lp = _Places(found["code"].to_numpy()), found["lp"].to_numpy()
        scores = []
        for some in docs.select(["form"]).to_batches(max_chunksize=256):
            forms = some.column(0).to_pylist()
            each = np.concatenate([lp[places.of(codes)] for codes in _parts(forms, depth)])
            scores.append(np.add.reduceat(each, np.cumsum([0, *map(len, forms[:-1])])) / _LN10)
        n_bytes = pc.cast(pc.binary_length(docs["form"]), pa.int64())
        score = pa.array(np.concatenate(scores) if scores else [], pa.float64())
        return pa.table({"doc_id": docs["doc_id"], "text_key": docs["text_key"], "score": score, "n_bytes": n_bytes})

    return score


def byte_scores(rows: DataFrame, depth: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(doc_id, text_key, score, n_bytes) of the distinct rows (doc_id, text_key, learn, text), by a model of those to learn.

    ``keep`` writes the result and reads it back; nothing else remains on disk.
    """
    with scratch(rows.sparkSession, "context-tree") as written:
        contexts = written(
            packed(rows, lambda: _Contexts(depth), "key long, n long, doc_id long, text_key long, form binary"), "contexts"
        )
        lengths = code_lengths(written(key_totals(contexts), "counts"), depth, written)
        scored = looked_up(
            contexts,
            ["doc_id", "text_key", "form"],
            lengths.withColumn("code", F.col("key")),
            _byte_scores(depth),
            "doc_id long, text_key long, score double, n_bytes long",
        )
        # rows that repeat have one form
        of_text = [F.any_value(c).alias(c) for c in ("score", "n_bytes")]
        return keep(scored.groupBy("doc_id", "text_key").agg(*of_text), "bytes")


def lm_scores(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, text_key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    A text is its words, A-Z lower-cased, each followed by a space, then an end. The model is a
    context tree over the bytes of that form, learnt from all documents whose crc32 of the id is no
    multiple of 10; the context of a byte is the ``depth`` bytes before it, in whatever words, with spaces
    before the first. ``score`` is the log10 probability of the text, ``bits_per_byte`` its code length in
    bits over ``n_bytes``, the bytes of the form. ``base_score`` is that of single tokens with 0.1 added to
    every count.

    Null, empty and blank texts have the end alone. Documents without an id are held out. Repeated rows
    are learnt from and scored each. Where nothing can be learnt from, every bit has probability one half.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise ValueError(f"contexts have 1 to {MOST_DEPTH} bytes")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("doc_id", text_key().alias("text_key"), training().alias("learn"), "text")
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    with scratch(spark, "tokens") as written:
        of_bytes = byte_scores(rows, depth, written)
        of_bytes = of_bytes.withColumnsRenamed({"doc_id": "of", "text_key": "of_key"})
        packs = written(
            packed(
                rows,
                _Tokens,
                "key binary, n long, doc_id long, text_key long, learn boolean, n_tokens long, places binary, times binary",
            ),
            "tokens",
        )
        vocabulary = written(key_totals(packs), "vocabulary")
        totals = vocabulary.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
        train_tokens, distinct = totals["n"] or 0, totals["v"] or 0

        def score(packed_docs: pa.Table, found: pa.Table) -> pa.Table:
            c = found["c"].to_numpy()
            base = np.log10((c + SMOOTHING) / (train_tokens + SMOOTHING * (distinct + 1)))
            out = []
            columns = (packed_docs["places"].to_pylist(), packed_docs["times"].to_pylist())
            for which, often in zip(*columns, strict=True):
                at, n = np.frombuffer(which, np.int32), np.frombuffer(often, np.int32).astype(np.int64)
                out.append((int(n[c[at] > 0].sum()), float(n @ base[at])))
            known, base_score = zip(*out, strict=True) if out else ([], [])
            return pa.table(
                {
                    "doc_id": packed_docs["doc_id"],
                    "text_key": packed_docs["text_key"],
                    "held_out": pc.invert(packed_docs["learn"]),
                    "n_tokens": packed_docs["n_tokens"],
                    "n_known": pa.array(known, pa.int64()),
                    "base_score": pa.array(base_score, pa.float64()),
                }
            )

        scored = looked_up(
            packs,
            ["doc_id", "text_key", "learn", "n_tokens", "places", "times"],
            vocabulary.withColumnRenamed("n", "c"),
            score,
            "doc_id long, text_key long, held_out boolean, n_tokens long, n_known long, base_score double",
        )
        same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))
        scored = scored.join(of_bytes, same).drop("of", "of_key")
        bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
        return stored(scored.withColumn("train_tokens", F.lit(train_tokens).cast("long")).withColumn("bits_per_byte", bits))
