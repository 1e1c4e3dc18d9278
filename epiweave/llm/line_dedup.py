"""Removal of lines that many documents repeat."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.llm.common import SPACE_CHARS, ascii_lower, small_batches, stored, text_key, text_or_empty, unused, with_decision

DROPPED, OPEN, EVIDENCE = 0, 1, 2
_MARKS = "h1 long, h2 long, doc_id long, text_key long, pos int, kind int"


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, text_key, pos) of every line whose key is long enough; 128 bits of hash."""
    lines = docs.select(
        "doc_id", text_key().alias("text_key"), F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line")
    )
    key = ascii_lower(F.trim(F.col("line"), F.lit(SPACE_CHARS)))
    return (
        lines.select("doc_id", "text_key", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_key", "pos")
    )


class _Runs:
    """Decides lines of one sorted partition as it streams by.

    Rows come by (hash, doc_id descending, nulls last): the first document of a run of
    equal hashes is the one that keeps the line. The first run of a partition may
    have begun in the one before, so its rows are passed on open. Of a run that is not
    decided yet only the rows of its first ``min_docs - 1`` documents are held. What
    the last run contributes to a run that goes on in the next partition is passed
    on as evidence.
    """

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.first = None
        self.in_first = True
        self.decided = None
        self.evidence = None
        self.held = None

    def feed(self, block: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if self.held is not None:
            block = pd.concat([self.held, block], ignore_index=True)
            self.held = None
        h1, h2 = block["h1"].to_numpy(), block["h2"].to_numpy()
        change = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        ends = np.append(change, len(block))
        key = (h1[0], h2[0])
        start = 0
        if self.first is None:
            self.first = key
        if self.in_first and key == self.first:
            start = ends[0]
            yield block.iloc[:start].assign(kind=OPEN)
        elif key == self.decided:
            start = ends[0]
            yield block.iloc[:start].assign(kind=DROPPED)
        if start == len(block):
            return
        self.in_first, self.decided, self.evidence = False, None, None
        block = block.iloc[start:].reset_index(drop=True)
        starts = np.append(0, ends[ends > start][:-1] - start)
        rank, count = self._documents(block, starts)
        last = starts[-1]
        if count[-1] < self.min_docs:
            self.held = block.iloc[last:]
            block, rank = block.iloc[:last], rank[:last]
            starts, count = starts[:-1], count[:-1]
        else:
            self.decided = (block["h1"].iloc[-1], block["h2"].iloc[-1])
            tail = block.iloc[last:]
            self.evidence = tail[rank[last:] < self.min_docs].drop_duplicates("doc_id")
        if len(block):
            run_docs = np.repeat(count, np.diff(np.append(starts, len(block))))
            gone = block[(run_docs >= self.min_docs) & (rank > 0)]
            if len(gone):
                yield gone.assign(kind=DROPPED)

    def finish(self) -> Iterator[pd.DataFrame]:
        if self.held is not None:
            yield self.held.assign(kind=OPEN)
        if self.evidence is not None:
            yield self.evidence.assign(kind=EVIDENCE)

    @staticmethod
    def _documents(block: pd.DataFrame, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the rank of its document in its run, per run the number of its documents."""
        none = block["doc_id"].isna().to_numpy()
        doc = block["doc_id"].fillna(0).to_numpy(np.int64)
        new = np.ones(len(block), np.int64)
        new[1:] = (doc[1:] != doc[:-1]) | (none[1:] != none[:-1])
        new[starts] = 1
        seen = np.cumsum(new)
        lengths = np.diff(np.append(starts, len(block)))
        rank = seen - np.repeat(seen[starts], lengths)
        return rank, rank[np.append(starts[1:], len(block)) - 1] + 1


def repeated_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, text_key, pos) of the lines to drop.

    Hashes are range-partitioned together with the document, so a line that a third
    of all documents hold is spread over as many partitions as it needs; each
    partition streams its sorted runs. Runs at partition borders are settled by a
    grouped count over what the partitions passed on.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(min_docs)
        schema = pa.schema(
            [(n, pa.int64()) for n in ("h1", "h2", "doc_id", "text_key")] + [("pos", pa.int32()), ("kind", pa.int32())]
        )

        def out(parts: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                yield pa.RecordBatch.from_pandas(part, schema=schema, preserve_index=False)

        for batch in batches:
            if batch.num_rows:
                block = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
                for name in ("h1", "h2", "text_key"):
                    block[name] = block[name].to_numpy(np.int64)
                yield from out(runs.feed(block))
        yield from out(runs.finish())

    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text_key", "pos")
    marks = stored(ranged.mapInArrow(decide, _MARKS))
    edge = marks.where(F.col("kind") != DROPPED)
    settled = (
        edge.groupBy("h1", "h2", "doc_id")
        .agg(F.lit(1))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("top"))
        .where(F.col("docs") >= min_docs)
    )
    late = edge.where(F.col("kind") == OPEN).join(settled, ["h1", "h2"]).where("NOT (doc_id <=> top)")
    columns = ["doc_id", "text_key", "pos"]
    return marks.where(F.col("kind") == DROPPED).select(columns).unionByName(late.select(columns))


def pack_kept(dropped: list[int]) -> bytes:
    """Compressed keep bitmap: bit i is 1 if line i stays; lines beyond its end stay."""
    keep = np.ones((max(dropped) // 8 + 1) * 8, np.uint8)  # the bits that fill the last byte stay 1
    keep[np.asarray(dropped)] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def apply_kept(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """The text without dropped lines, its lines before, and how many went."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return text or "", len(lines), 0
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
    kept = [line for i, line in enumerate(lines) if i >= len(keep) or keep[i]]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_key, bitmap) of the documents that lose lines."""

    @F.pandas_udf("binary")
    def pack(positions: pd.Series) -> pd.Series:
        return positions.map(pack_kept)

    gone = repeated_lines(line_hashes(docs, min_chars), min_docs)
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("pos")).select(
        "doc_id", "text_key", pack("pos").alias("bitmap")
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, name: str = "deduped") -> DataFrame:
    """The documents with ``deduped`` (or ``name``; text, n_lines, n_dropped) beside their own columns.

    A line's key is the line without spaces and controls 9 to 13 at its ends, A-Z
    lower-cased. Keys of at least ``min_chars`` code points held by at least
    ``min_docs`` documents lose all their lines except in the document with the largest
    doc_id. Documents are told apart by doc_id: repeated rows of one id hold a line
    together, rows without an id count as one document smaller than all others. A null
    or empty text is one empty line. An empty table gives no rows. A column of the documents
    that is itself of that name is replaced; all others stay.
    """

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def applied(texts: pd.Series, bitmaps: pd.Series) -> pd.DataFrame:
        found = [apply_kept(t, b) for t, b in zip(texts, bitmaps, strict=True)]
        return pd.DataFrame(found, columns=["text", "n_lines", "n_dropped"])

    bitmaps = keep_bitmaps(docs, min_chars, min_docs)
    small_batches(docs.sparkSession)
    bitmap = unused(docs, "_bitmap")
    marked = with_decision(docs, bitmaps, [F.col("bitmap").alias(bitmap)])
    return marked.withColumn(name, applied("text", bitmap)).drop(bitmap)
