"""Exact distinct counts of a stored table's columns from bitmaps kept per date.

Beside a table lie, under ``distinct_sets/<table>/<column>``,

- ``ids``: (value, id), a dictionary that gives every value met so far a number from 1 on, without gaps
  but for loads that died;
- ``by-<group>``: (day, part, bucket, bits, version), per date and value of a grouping column the bitmap of
  the ids held, in buckets of 32,768 ids; ``by-`` alone has one part for all rows.

A load writes both before its rows and the calendar after them, all under one version. Bitmaps count only
under the version the calendar has for their date, so those of loads that were replaced or died do not.
Counts over any dates are unions of bitmaps: no row of the table is read, and no value is shuffled.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epiweave.schemas import TABLES
from epiweave.sources.value_index import children

_IDS = "value string, id bigint"
_SETS = "day date, part string, bucket bigint, bits binary, version bigint"
#: Groups in which new values are numbered; only the number of values of each is put in one order.
NUMBERING_GROUPS = 4096


def _path(root: str, name: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), "distinct_sets", name, *parts])


def declare_distinct(
    spark: SparkSession, root: str, name: str, column: str, rows: DataFrame, calendar: DataFrame, group: str = ""
) -> None:
    """Keep the distinct values of a column, by a grouping column if one is given, from now on.

    Starts from the ``rows`` and the versions of the ``calendar``; sets that exist are left as they are.
    """
    if f"by-{group}" in children(spark, _path(root, name, column)):
        return
    versions = calendar.select(F.col(TABLES[name].partition).alias("day"), "version")
    load = time.time_ns()
    _number_values(spark, root, name, column, rows, load)
    _write_sets(spark, root, name, column, group, rows, load, versions)


def record_sets(spark: SparkSession, root: str, name: str, rows: DataFrame, version: int) -> None:
    """Add the sets of a load, for every column declared; ``rows`` are all rows of their dates."""
    for column in children(spark, _path(root, name)):
        _number_values(spark, root, name, column, rows, version)
        for kept in children(spark, _path(root, name, column)):
            if kept.startswith("by-"):
                _write_sets(spark, root, name, column, kept.removeprefix("by-"), rows, version)


def _number_values(spark: SparkSession, root: str, name: str, column: str, rows: DataFrame, load: int) -> None:
    """Give ids to the values that have none yet."""
    values = rows.select(F.col(column).cast("string").alias("value")).na.drop().distinct()
    last: int | Column = 0
    if "ids" in children(spark, _path(root, name, column)):
        known = spark.read.schema(_IDS).parquet(_path(root, name, column, "ids"))
        values = values.join(known, "value", "left_anti")
        last = F.coalesce(known.agg(F.max("id")).scalar(), F.lit(0))
    # Numbered within hash groups, and from where the groups before end: no task sees all values.
    grouped = values.withColumn("part", F.pmod(F.xxhash64("value"), F.lit(NUMBERING_GROUPS)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    numbered = grouped.withColumn("place", place).join(starts, "part")
    ids = numbered.select("value", (F.lit(0) + last + F.col("start") + F.col("place")).cast("bigint").alias("id"))
    ids.write.parquet(_path(root, name, column, "ids", f"load={load}"))


def _write_sets(
    spark: SparkSession,
    root: str,
    name: str,
    column: str,
    group: str,
    rows: DataFrame,
    load: int,
    versions: DataFrame | None = None,
) -> None:
    ids = spark.read.schema(_IDS).parquet(_path(root, name, column, "ids"))
    part = F.col(group).cast("string") if group else F.lit(None).cast("string")
    held = rows.select(
        F.col(TABLES[name].partition).alias("day"), part.alias("part"), F.col(column).cast("string").alias("value")
    ).distinct()
    # A group without a value still has a row, and so a count of 0.
    at = held.join(ids, "value", "left").select(
        "day", "part", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit")
    )
    sets = at.groupBy("day", "part", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    if versions is None:
        sets = sets.withColumn("version", F.lit(load))
    else:
        sets = sets.join(versions, "day", "left").fillna(0, ["version"])
    path = _path(root, name, column, f"by-{group}", f"load={load}")
    sets.select("day", "part", "bucket", "bits", "version").write.option("compression", "zstd").parquet(path)


def read_sets(
    spark: SparkSession, root: str, name: str, column: str, calendar: DataFrame, group: str = ""
) -> DataFrame:
    """(day, part, bucket, bits) of all dates as the loads so far left them; ``part`` is null without a group."""
    versions = calendar.select(F.col(TABLES[name].partition).alias("day"), "version")
    written = spark.read.schema(_SETS).parquet(_path(root, name, column, f"by-{group}"))
    return written.join(versions, ["day", "version"]).select("day", "part", "bucket", "bits")


def count_sets(sets: DataFrame, *by: str) -> DataFrame:
    """Distinct values (``n``) of the union of sets, by any of ``day`` and ``part``, or one row for all."""
    merged = sets.groupBy(*by, "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    counts = F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(0))
    return merged.groupBy(*by).agg(F.coalesce(counts, F.lit(0)).alias("n"))
