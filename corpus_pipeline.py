"""The corpus pipeline: from raw documents to the mix that training takes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epiweave.llm import decontamination, language, line_dedup, mixing, simhash
from epiweave.llm.common import freeing_shuffles, remove_folder, ship_package, unused
from epiweave.session import shared_dir
from epiweave.sources.testdata import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be determined."""
    return language.identified_documents(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines they keep as text, and n_chars of that."""
    name = unused(docs, "deduped")
    kept = line_dedup.dedup_lines(docs, name=name)
    new = {"text": f"{name}.text", "n_chars": f"char_length({name}.text)"}
    types = dict(docs.dtypes)
    return kept.selectExpr(*(f"CAST({new[c]} AS {types[c]}) AS `{c}`" if c in new else f"`{c}`" for c in docs.columns))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    items = table(spark, sf_dir.rstrip("/"), "benchmark")
    return decontamination.clean_documents(docs, items, short_similarity=decontamination.SHORT_SIMILARITY)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes and how many copies of each."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("simhash", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: None: the first stage applies a trained network.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages a Parquet table in the shared folder.

    A stage's table is removed once the next one is written, and all of them after a failure.
    The rows returned are those of the last, which the caller may remove when done.

    Rows may repeat, ids may be null or repeat, and documents may have further columns of any name, which
    go through; null texts and texts without a letter go in the first stage. No documents give no rows.
    """
    ship_package(spark)
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    last = None
    try:
        for i, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{i}-{name}"
            with freeing_shuffles(spark):
                stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove_folder(spark, last)
            last = path
    except BaseException:
        remove_folder(spark, folder)
        raise
    return docs
