"""Removal of long byte strings that occur more than once, by grouping hashes at content-chosen anchors.

No suffix is sorted and no pass takes leading bytes. A most-significant-digit sort of all suffixes
would write a row of 16 bytes for every byte of text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.llm.common import freeing_shuffles, small_batches, stored, text_key, unused, with_decision
from epiweave.session import shared_dir

#: Suffixes handled at once; bounds the memory a very long text takes.
CHUNK = 1 << 18
#: Suffixes grouped at once in the second pass.
CELL = 12
_POSITION = np.uint64(21)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Digits:
    """How suffixes are grouped for a depth of ``length`` bytes.

    Every suffix has an anchor in its first ``length`` bytes: the place of the least
    ``sample``-byte hash among them, taken modulo ``stride`` as a distance from the suffix. Equal
    strings have equal anchors, and the ``core`` bytes from the anchor on lie inside every
    suffix of that anchor. Their hash is grouped first; one row per anchor stands for all its suffixes.
    """

    def __init__(self, length: int):
        if length < 12:
            raise ValueError("the threshold is at least 12 bytes")
        self.length = length
        self.core = min(length, length // 2 + 6)
        self.stride = length - self.core + 1
        self.sample = max(1, 2 * self.core - length - 1)

    def reach(self) -> int:
        """Bytes before the anchor that some suffix of it may begin at."""
        return self.stride - 1


@lru_cache(4)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = (np.cumprod(np.full(size, b, np.uint64)) for b in (base, inverse))
    one = np.ones(1, np.uint64)
    return np.concatenate([one, up]), np.concatenate([one, down])


@lru_cache(2)
def _values(which: int) -> np.ndarray:
    return np.random.default_rng(which).integers(0, 1 << 64, 256, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashes:
    """Hashes of any byte range of a text, from sums of byte values times powers (modulo 2**64)."""

    def __init__(self, data: np.ndarray, which: int, most: int):
        values = _values(which)
        up, self.down = _powers(_BASES[which], most)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def all(self, size: int) -> np.ndarray:
        count = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:count]) * self.down[:count])


def _anchors(hashes: Hashes, d: Digits) -> np.ndarray:
    """The anchor of every suffix of at least ``length`` bytes; the leftmost of equal hashes."""
    grams = hashes.all(d.sample)
    packed = (grams >> _POSITION << _POSITION) | np.arange(len(grams), dtype=np.uint64)
    width, size = d.length - d.sample + 1, 1
    least = packed
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: size - width], least[width - size :])
    place = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
    suffix = np.arange(len(place))
    return suffix + (place - suffix) % d.stride


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int, d: Digits) -> np.ndarray:
    """Hashes of byte ranges, each shorter than twice the threshold; texts are read in chunks."""
    out = np.empty(len(start), np.uint64)
    for first in range(0, len(data), CHUNK):
        here = (start >= first) & (start < first + CHUNK) if len(data) > CHUNK else slice(None)
        piece = data[first : first + CHUNK + 2 * d.length]
        out[here] = Hashes(piece, which, CHUNK + 2 * d.length).of(start[here] - first, end[here] - first)
    return out


def _rows(data: np.ndarray, core: tuple, full: tuple, first: np.ndarray, last: np.ndarray, salt: int, d: Digits):
    """(core, full, first, last) with hashes of the ranges; where ``full`` leaves the text it is a value of its own."""
    low, high = full
    inside = (low >= 0) & (high <= len(data))
    own = _mixed(first.astype(np.uint64) ^ np.uint64(salt))
    whole = np.where(inside, range_hashes(data, np.maximum(low, 0), np.where(inside, high, np.maximum(low, 0)), 0, d), own)
    return range_hashes(data, *core, 0, d).view(np.int64), whole.view(np.int64), first, last


def anchor_rows(data: np.ndarray, salt: int, d: Digits) -> tuple[np.ndarray, ...]:
    """(core, full, first, last, at): the anchors of a text and the suffixes each stands for.

    ``full`` hashes all bytes that suffixes of the anchor can reach; equal ``full`` means that all
    their suffixes agree.
    """
    parts = [(np.empty(0, np.int64),) * 3]
    for begin in range(0, len(data) - d.length + 1, CHUNK):
        piece = data[begin : begin + CHUNK + d.length - 1]
        anchors = _anchors(Hashes(piece, 0, CHUNK + 2 * d.length), d)
        starts = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        ends = np.append(starts[1:], len(anchors)) - 1
        parts.append((starts + begin, ends + begin, anchors[starts] + begin))
    first, last, at = map(np.concatenate, zip(*parts, strict=True))
    new = np.flatnonzero(np.diff(at, prepend=-1))  # an anchor whose suffixes lie in two chunks is one row
    first, last, at = first[new], last[np.append(new[1:], len(at)) - 1] if len(at) else last, at[new]
    return *_rows(data, (at, at + d.core), (at - d.reach(), at + d.length), first, last, salt, d), at


def cell_rows(data: np.ndarray, asked: list[np.ndarray], salt: int, d: Digits) -> tuple[np.ndarray, ...]:
    """(core, full, first, last) of CELL suffixes at a time, by their distance from the anchor."""
    first, last, at = asked
    low, high = (at - last) // CELL, (at - first) // CELL
    each = high - low + 1
    owner = np.repeat(np.arange(len(at)), each)
    cell = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each) + low[owner]
    begin = at[owner] - np.minimum((cell + 1) * CELL - 1, d.reach())
    end = at[owner] - cell * CELL
    mine = np.maximum(begin, first[owner]), np.minimum(end, last[owner])
    return _rows(data, (end, begin + d.length), (begin, end + d.length), *mine, salt, d)


def suffix_rows(data: np.ndarray, asked: list[np.ndarray], salt: int, d: Digits) -> tuple[np.ndarray, ...]:
    """(h1, h2, place) of every suffix in the ranges asked for."""
    first, last = asked
    wanted = np.zeros(len(data) + 1, np.int32)
    np.add.at(wanted, first, 1)
    np.add.at(wanted, last + 1, -1)
    places = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
    one, two = (range_hashes(data, places, places + d.length, k, d).view(np.int64) for k in (0, 1))
    return one, two, places


def _scanned(docs: DataFrame, names: list[str], rows, asked: list[str] | None, d: Digits) -> DataFrame:
    """Rows (names, doc_id, text_key) that ``rows`` makes of every text and what is asked of it."""
    schema = pa.schema([(n, pa.int64()) for n in [*names, "doc_id", "text_key"]])

    def batch(parts: list[tuple], ids: list, keys: list) -> pa.RecordBatch:
        sizes = [len(part[0]) for part in parts]
        columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
        none = np.repeat([i is None for i in ids], sizes)
        columns.append(pa.array(np.repeat(np.array([i or 0 for i in ids], np.int64), sizes), mask=none))
        columns.append(pa.array(np.repeat(np.array(keys, np.int64), sizes)))
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, ids, keys, held = [], [], [], 0
        for given in batches:
            for doc_id, key, text, *lists in zip(*given.columns, strict=True):
                doc_id, key = doc_id.as_py(), key.as_py()
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
                if len(data) < d.length:
                    continue
                salt = (key + (doc_id or 0) * _BASES[1]) & (1 << 64) - 1
                spans = [[v.to_numpy(zero_copy_only=False) for v in x.values.flatten()] for x in lists]
                found = rows(data, *spans, salt, d)
                parts.append(found[: len(names)])
                ids.append(doc_id)
                keys.append(key)
                held += len(found[0])
                if held >= 1 << 16:
                    yield batch(parts, ids, keys)
                    parts, ids, keys, held = [], [], [], 0
        if held:
            yield batch(parts, ids, keys)

    columns = ["doc_id", "text_key", F.col("text").cast("binary"), *(["ranges"] if asked else [])]
    return docs.select(columns).mapInArrow(scan, ", ".join(f"{n} long" for n in schema.names))


def _asked_of(docs: DataFrame, asked: DataFrame, fields: list[str]) -> DataFrame:
    """The texts something is asked of, with the list of that."""
    ranges = asked.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*fields)).alias("ranges"))
    return with_decision(docs.select("doc_id", "text"), ranges, ["ranges", F.col("text_key").alias("text_key")], "inner")


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """Rows kept as a compressed table in the shared folder, and its path."""
    path = f"{shared_dir(df.sparkSession)}/suffixes-{uuid.uuid4().hex}"
    with freeing_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _removed(df: DataFrame, path: str) -> None:
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def _digit_pass(rows: DataFrame, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """Suffix ranges known to be repeated, and those of which the next pass must tell.

    A core that occurs once ends all its suffixes. In a group whose full contexts are all equal,
    all suffixes are repeated. In the others, contexts held twice are repeated as well; one of
    each goes on, with those held once. Groups are only counted, combined before the shuffle.
    """
    fields = ["doc_id", "text_key", "first", "last"]
    cores = rows.groupBy("core").agg(F.count("*").alias("n"), F.min("full").alias("low"), F.max("full").alias("high"))
    cores = stored(cores.where("n > 1").select("core", (F.col("low") == F.col("high")).alias("alike")))
    grouped, path = _written(rows.join(cores, "core"))
    mixed = grouped.where("NOT alike")
    # Stored, so that the join splits a context that many rows share; contexts held once need no row.
    classes = mixed.groupBy(F.col("core").alias("_core"), F.col("full").alias("_full")).agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "first")).alias("one")
    )
    classes = stored(classes.where("n > 1").drop("n"))
    same = (mixed["core"] == classes["_core"]) & (mixed["full"] == classes["_full"])
    known = F.col("_full").isNotNull()
    first_one = F.struct("doc_id", "text_key", "first").eqNullSafe(F.col("one"))
    judged = mixed.join(classes, same, "left").select(*fields, *more, known.alias("known"), (~known | first_one).alias("next"))
    judged, judged_path = _written(judged)
    known = stored(grouped.where("alike").select(fields).unionByName(judged.where("known").select(fields)))
    going_on = stored(judged.where("next").select(*fields, *more).distinct())
    _removed(rows, path)
    _removed(rows, judged_path)
    return known, going_on


def repeated_suffixes(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_key, first, last): ranges of suffixes whose first ``length`` bytes start elsewhere too.

    Three passes of grouping by hashes: the first groups anchors, one row for some 60 suffixes, by
    the hash of their core; the second, in the groups the first leaves open, CELL suffixes at a
    time; the last groups what is still open suffix by suffix, by two 64-bit hashes of all its
    ``length`` bytes. Bytes are not compared. Groups are counted and never gathered.
    """
    d = Digits(length)
    small_batches(docs.sparkSession)
    # Rows that agree in doc_id and text are documents of their own: they count as many times over.
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    anchors = _scanned(keyed, ["core", "full", "first", "last", "at"], anchor_rows, None, d)
    known, going_on = _digit_pass(anchors, ["at"])
    texts = _asked_of(docs, going_on, ["first", "last", "at"])
    cells, path = _written(_scanned(texts, ["core", "full", "first", "last"], cell_rows, ["ranges"], d))
    more, going_on = _digit_pass(cells, [])
    _removed(docs, path)
    texts = _asked_of(docs, going_on, ["first", "last"])
    suffixes, path = _written(_scanned(texts, ["h1", "h2", "place"], suffix_rows, ["ranges"], d))
    groups = stored(suffixes.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    late = suffixes.join(groups, ["h1", "h2"]).select(
        "doc_id", "text_key", F.col("place").alias("first"), F.col("place").alias("last")
    )
    late = stored(late)
    _removed(docs, path)
    return known.unionByName(more).unionByName(late)


def covered(size: int, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """Which bytes the windows that start in the ranges cover, and the number of maximal runs."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, np.minimum(last + length, size), -1)
    gone = np.cumsum(change[:-1]) > 0
    return gone, int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """The documents with ``cut`` (kept binary, n_bytes, n_removed, n_spans) beside their own columns.

    Texts are UTF-8 bytes, null ones empty. Every byte covered by a string of ``length`` bytes that
    also starts anywhere else in the input, the same document included, is removed; the kept bytes
    may therefore end inside a character. Texts shorter than that lose nothing. Repeated rows
    are documents of their own, so they lose all they have in common. An empty table gives no rows.
    A column of the documents that is itself named ``cut`` is replaced; all others stay.
    """
    spans_of = unused(docs, "_ranges")
    ranges = (
        repeated_suffixes(docs, length)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("first", "last")).alias(spans_of))
    )

    @F.pandas_udf("kept binary, n_bytes long, n_removed long, n_spans long")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, ranges, strict=True):
            text = text or b""
            if spans is None or not len(spans):
                out.append((text, len(text), 0, 0))
                continue
            first, last = (np.fromiter((s[k] for s in spans), np.int64, len(spans)) for k in ("first", "last"))
            gone, runs = covered(len(text), first, last, length)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            out.append((kept, len(text), len(text) - len(kept), runs))
        return pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])

    marked = with_decision(docs, ranges, [spans_of])
    return marked.withColumn("cut", cut(F.col("text").cast("binary"), spans_of)).drop(spans_of)
