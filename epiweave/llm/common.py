"""What several text operators share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.session import shared_dir

SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application.

    They need it for the functions that run in tasks where it is not installed. The driver
    serves the archive from a folder of its own as long as it lives.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        folder = _shipped[context.applicationId] = tempfile.TemporaryDirectory()
        context.addPyFile(shutil.make_archive(f"{folder.name}/epiweave", "zip", root, "epiweave"))


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action are removed as soon as it has ended."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Compute once, keep on the shared storage and cut the lineage.

    A lost executor loses none of these rows, and the shuffles that led to them
    are given up at once.
    """
    shared_dir(df.sparkSession)
    with freeing_shuffles(df.sparkSession):
        return df.checkpoint()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate rows, wherever it lies; a missing one is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark hand texts to Python at most ``rows`` at a time, in this session from now on.

    Texts are long rows: the default of 10,000 holds some 30 MB of them twice per task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def text_key(text: str | Column = "text") -> Column:
    """64-bit key of a text; with ``doc_id`` it tells rows apart whose ids repeat or are null."""
    return F.xxhash64(text_or_empty(text))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does that to texts of one byte per character."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text between spaces and the controls 9 to 13, A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split() if text else []


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_decision(docs: DataFrame, decision: DataFrame, columns: list[str], how: str = "left") -> DataFrame:
    """Rows of ``docs`` with columns of a decision keyed by (doc_id, text_key), each key at most once.

    Ids may be null or repeat. The decision's columns replace none of the documents'.
    """
    names = (unused(docs, "_doc_id"), unused(docs, "_text_key"))
    keyed = decision.select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1]), *columns)
    same = docs["doc_id"].eqNullSafe(keyed[names[0]]) & (text_key(docs["text"]) == keyed[names[1]])
    joined = docs.join(keyed, same, how)
    return joined if how == "left_semi" else joined.drop(*names)
