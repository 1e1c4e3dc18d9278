"""Look-ups in a corpus-wide table for many documents at once.

Documents are packed, as they are read, into chunks of bounded size. A chunk names each
key its documents need once, so that the shuffle to the table carries distinct keys of
chunks and not every occurrence, and no table is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.llm.common import freeing_shuffles
from epiweave.session import shared_dir

#: Bytes of text after which a chunk is full; a longer text is a chunk of its own.
CHUNK_BYTES = 16 << 20
#: Bytes of rows that are worked on at once, unless one row has more.
PIECE_BYTES = 4 << 20


@contextmanager
def scratch(spark: SparkSession, purpose: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that writes a table to the shared folder and reads it back.

    The tables are removed on leaving, also after a failure; what is returned must not need them.
    """
    folder = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        with freeing_shuffles(spark):
            df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    try:
        yield written
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Packer:
    """Packs the documents of one task; a subclass says what a document needs.

    ``add`` takes a batch of rows and returns their packed rows, ``keys`` the columns
    (key, n) of the keys that the chunk's documents name by place, and ``start`` forgets them.
    """

    #: Arrow fields of a packed document, and the type of a key.
    fields: list[tuple[str, pa.DataType]]
    key: pa.DataType

    def start(self) -> None:
        raise NotImplementedError

    def add(self, batch: pa.RecordBatch) -> list[pa.Array]:
        raise NotImplementedError

    def keys(self) -> tuple[pa.Array, pa.Array]:
        raise NotImplementedError

    def size(self, batch: pa.RecordBatch) -> int:
        return batch.column("text").nbytes

    def schema(self) -> pa.Schema:
        of_key = [("pos", pa.int32()), ("key", self.key), ("n", pa.int64())]
        return pa.schema([("chunk", pa.int64()), *of_key, *self.fields])

    def run(
        self, batches: Iterator[pa.RecordBatch], chunk_bytes: int, piece_bytes: int
    ) -> Iterator[pa.RecordBatch]:
        task, made, filled = TaskContext.get().partitionId(), 0, 0
        schema = self.schema()

        def rows(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
            chunk = pa.array([(task << 32) + made] * n, pa.int64())
            columns = {"chunk": chunk, **columns}
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

        def close() -> Iterator[pa.RecordBatch]:
            key, n = self.keys()
            for at in range(0, len(key), 1 << 14):
                part = key[at : at + (1 << 14)]
                pos = pa.array(range(at, at + len(part)), pa.int32())
                yield rows(len(part), {"pos": pos, "key": part, "n": n[at : at + len(part)]})

        self.start()
        for batch in (piece for whole in batches for piece in _pieces(whole, piece_bytes)):
            if filled and filled + self.size(batch) > chunk_bytes:
                yield from close()
                self.start()
                made, filled = made + 1, 0
            filled += self.size(batch)
            packed = self.add(batch)
            yield rows(batch.num_rows, dict(zip((name for name, _ in self.fields), packed, strict=True)))
        yield from close()


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and batch.nbytes > most:
        half = batch.num_rows // 2
        yield from _pieces(batch.slice(0, half), most)
        yield from _pieces(batch.slice(half), most)
    elif batch.num_rows:
        yield batch


def packed(docs: DataFrame, packer: Callable[[], Packer], schema: str) -> DataFrame:
    """Rows of documents (pos null) and of the keys their chunk needs (pos, key, n), told apart by ``pos``.

    Must be written before it is read twice: chunks are numbered as the rows are read.
    """
    sizes = (CHUNK_BYTES, PIECE_BYTES)
    return docs.mapInArrow(lambda batches: packer().run(batches, *sizes), f"chunk long, pos int, {schema}")


def looked_up(
    packs: DataFrame,
    fields: list[str],
    values: DataFrame,
    apply: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """``apply`` on every chunk: its packed documents and the rows (pos, values …) of its keys.

    ``values`` has one row per ``key``; every key must have one.
    """
    found = packs.where("pos IS NOT NULL").select("chunk", "pos", "key").join(values, "key").drop("key")
    docs = packs.where("pos IS NULL").select(F.col("chunk").alias("of"), *fields)

    def of_chunk(left: pa.Table, right: pa.Table) -> pa.Table:
        return apply(left, right.sort_by("pos"))

    return docs.groupBy("of").cogroup(found.groupBy("chunk")).applyInArrow(of_chunk, schema)


def key_totals(packs: DataFrame) -> DataFrame:
    """(key, n): each key once, with the sum over all chunks."""
    return packs.where("pos IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
