"""Indexes of column values beside a table: the dates each value has rows on, and the trigrams of texts.

An index holds, under ``value_index/<table>/<column>``, (value, day, n, version): rows per value and
date, sorted by value, written by every load for the dates it rewrites. A load writes its entries before
its rows and the calendar after them, all under one version, so that

- a look-up takes the dates of a value under any version: entries of loads that were replaced or died
  cost the opening of a date in vain, never a missed row;
- counts are taken only under the version the calendar has for the date.

A text index also holds (gram, value) for all three-character pieces of the values.
"""

from __future__ import annotations

import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epiweave.schemas import TABLES

_ENTRIES = "value string, day date, n bigint, version bigint"
_GRAMS = "gram string, value string"
GRAM = 3


def _index_path(root: str, name: str, column: str, part: str = "") -> str:
    return "/".join([root.rstrip("/"), "value_index", name, *filter(None, (column, part))])


def children(spark: SparkSession, path: str) -> list[str]:
    """Names within a folder, none if it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []


def indexed_columns(spark: SparkSession, root: str, name: str) -> list[str]:
    """Columns of a table that have an index."""
    return children(spark, _index_path(root, name, ""))


def declare_index(
    spark: SparkSession, root: str, name: str, column: str, rows: DataFrame, calendar: DataFrame, text: bool = False
) -> None:
    """Index a column of a table, from its ``rows`` and its calendar; one that exists is left as it is."""
    if column in indexed_columns(spark, root, name):
        return
    versions = calendar.select(F.col(TABLES[name].partition).alias("day"), "version")
    # A date whose load died before the calendar has no version yet; look-ups must find it all the same.
    entries = _count_values(rows, name, column).join(versions, "day", "left").fillna(0, ["version"])
    _write_entries(root, name, column, entries, time.time_ns())
    if text:
        _write_grams(root, name, column, rows, time.time_ns())


def record_values(spark: SparkSession, root: str, name: str, rows: DataFrame, version: int) -> None:
    """Add the entries of a load to every index of the table; ``rows`` are all rows of their dates."""
    for column in indexed_columns(spark, root, name):
        counted = _count_values(rows, name, column).withColumn("version", F.lit(version))
        _write_entries(root, name, column, counted, version)
        if "grams" in children(spark, _index_path(root, name, column)):
            _write_grams(root, name, column, rows, version)


def _count_values(rows: DataFrame, name: str, column: str) -> DataFrame:
    value, day = F.col(column).cast("string").alias("value"), F.col(TABLES[name].partition).alias("day")
    return rows.groupBy(value, day).agg(F.count("*").alias("n"))


def _write_entries(root: str, name: str, column: str, entries: DataFrame, load: int) -> None:
    # Ranges of values in order: a look-up by value reads few row groups.
    ordered = entries.select("value", "day", "n", "version").repartitionByRange("value", "day")
    path = _index_path(root, name, column, f"entries/load={load}")
    ordered.sortWithinPartitions("value", "day").write.parquet(path)


def _write_grams(root: str, name: str, column: str, rows: DataFrame, load: int) -> None:
    values = rows.select(F.col(column).cast("string").alias("value")).distinct().filter(F.length("value") >= GRAM)
    starts = F.sequence(F.lit(1), F.length("value") - (GRAM - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("value"), i, F.lit(GRAM))))
    ordered = values.select(F.explode(grams).alias("gram"), "value").repartitionByRange("gram", "value")
    path = _index_path(root, name, column, f"grams/load={load}")
    ordered.sortWithinPartitions("gram", "value").write.parquet(path)


def _read(spark: SparkSession, root: str, name: str, column: str, part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(_index_path(root, name, column, part))


def days_of_value(spark: SparkSession, root: str, name: str, column: str, value: str) -> DataFrame:
    """(day) on which the value may have rows; no date on which it has some is missing."""
    entries = _read(spark, root, name, column, "entries", _ENTRIES)
    return entries.filter(F.col("value") == value).select("day").distinct()


def days_like(spark: SparkSession, root: str, name: str, column: str, part: str) -> DataFrame:
    """(day) on which values that hold ``part``, a LIKE fragment, may have rows.

    The fragment's trigrams between wildcards find the candidate values, LIKE decides. A fragment without
    any, or an index without trigrams, is compared with every distinct value instead.
    """
    entries = _read(spark, root, name, column, "entries", _ENTRIES)
    like = F.col("value").like(f"%{part}%")
    grams = literal_grams(part)
    if grams and "grams" in children(spark, _index_path(root, name, column)):
        pieces = _read(spark, root, name, column, "grams", _GRAMS).filter(F.col("gram").isin(grams) & like)
        found = pieces.groupBy("value").agg(F.count_distinct("gram").alias("held")).filter(F.col("held") == len(grams))
        entries = entries.join(found, "value", "left_semi")
    return entries.filter(like).select("day").distinct()


def literal_grams(part: str) -> list[str]:
    """Distinct trigrams of the stretches of a LIKE fragment that hold no wildcard or escape."""
    stretches = re.split(r"[%_\\]", part)
    return sorted({s[i : i + GRAM] for s in stretches for i in range(len(s) - GRAM + 1)})


def days_of_last_rows(
    spark: SparkSession, root: str, name: str, column: str, rows: int, calendar: DataFrame
) -> DataFrame:
    """(day) that hold the newest ``rows`` rows of each value, whole dates; an old key keeps its old dates."""
    versions = calendar.select(F.col(TABLES[name].partition).alias("day"), "version")
    entries = _read(spark, root, name, column, "entries", _ENTRIES).join(versions, ["day", "version"])
    # Compaction may leave an entry twice for a moment.
    counts = entries.groupBy("value", "day").agg(F.max("n").alias("n"))
    newer = Window.partitionBy("value").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(newer), F.lit(0))
    return counts.withColumn("before", before).filter(F.col("before") < rows).select("day").distinct()


def on_days(rows: DataFrame, date: str, days: DataFrame) -> DataFrame:
    """Rows of the given dates; as a subquery in a partition filter, so no other date's files are opened.

    The list holds at most one entry per date of the calendar.
    """
    return rows.filter(F.array_contains(days.agg(F.collect_set("day")).scalar(), F.col(date)))


def compact_index(spark: SparkSession, root: str, name: str, column: str, calendar: DataFrame) -> None:
    """Put an index's loads together, without the entries of replaced ones; for a time with no load running.

    Entries newer than the calendar stay, as their rows may be there. The new files are whole before the
    old go; a reader in between sees entries twice, which changes nothing.
    """
    versions = calendar.select(F.col(TABLES[name].partition).alias("day"), F.col("version").alias("current"))
    parts = children(spark, _index_path(root, name, column))
    old = {part: children(spark, _index_path(root, name, column, part)) for part in parts}
    entries = _read(spark, root, name, column, "entries", _ENTRIES).join(versions, "day", "left")
    kept = entries.filter(F.col("version") >= F.coalesce("current", F.lit(0)))
    load = time.time_ns()
    _write_entries(root, name, column, kept.dropDuplicates(["value", "day", "version"]), load)
    if "grams" in parts:
        written = _read(spark, root, name, column, f"entries/load={load}", _ENTRIES)
        _write_grams(root, name, column, written.select(F.col("value").alias(column)), load)
    for part, loads in old.items():
        for folder in loads:
            path = spark._jvm.org.apache.hadoop.fs.Path(_index_path(root, name, column, f"{part}/{folder}"))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
