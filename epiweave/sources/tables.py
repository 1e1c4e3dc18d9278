"""Week-partitioned Parquet tables: declare, read, upsert, replace, count."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from epiweave.schemas import TABLES, Table
from epiweave.session import materialise, shared_dir
from epiweave.sources import distinct_sets, value_index


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def calendar_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/calendar/{name}"


def _stored_schema(table: Table) -> StructType:
    return StructType([*table.schema.fields, StructField("_seq", LongType())])


def declare_tables(spark: SparkSession, root: str, names: tuple[str, ...] = tuple(TABLES)) -> None:
    """Create missing tables; existing ones are left as they are."""
    for name in names:
        table = TABLES[name]
        empty = spark.createDataFrame([], _stored_schema(table))
        empty.write.mode("ignore").partitionBy(table.partition).parquet(table_path(root, name))
        _write_calendar(_count_dates(read_stored(spark, root, name), table), table, root, "ignore", time.time_ns())


def read_stored(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table with its version column; the schema is given, never inferred."""
    return spark.read.schema(_stored_schema(TABLES[name])).parquet(table_path(root, name))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return read_stored(spark, root, name).select(*TABLES[name].schema.names)


def _calendar_schema(table: Table) -> StructType:
    return StructType([table.schema[table.partition], StructField("n", LongType()), StructField("version", LongType())])


def read_calendar(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows per date of a table: (its partition column, n).

    Every load appends the counts of the dates it wrote, in one small file, so finding the
    newest dates reads no rows of the table. They are written after the rows: between
    the two the calendar is as old as the load before.
    """
    return read_versions(spark, root, name).drop("version")


def read_versions(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The calendar with the version of the load that last wrote each date."""
    table = TABLES[name]
    counts = spark.read.schema(_calendar_schema(table)).parquet(calendar_path(root, name))
    return counts.groupBy(table.partition).agg(F.max_by("n", "version").alias("n"), F.max("version").alias("version"))


def compact_calendar(spark: SparkSession, root: str, name: str) -> None:
    """Put the calendar's files together; for tables loaded many times a day."""
    table = TABLES[name]
    counts = materialise(read_versions(spark, root, name))
    _write_calendar(counts, table, root, "overwrite")


def _write_calendar(counts: DataFrame, table: Table, root: str, mode: str, version: int | None = None) -> None:
    stamp = F.col("version") if version is None else F.lit(version).alias("version")
    counts.select(table.partition, "n", stamp).coalesce(1).write.mode(mode).parquet(calendar_path(root, table.name))


def declare_lookup(spark: SparkSession, root: str, name: str, column: str, text: bool = False) -> None:
    """Index a column from now on, with the rows stored so far; ``text`` also serves LIKE look-ups.

    Files of later loads are ordered by the table's indexed columns within each date.
    """
    rows = read_stored(spark, root, name)
    value_index.declare_index(spark, root, name, column, rows, read_versions(spark, root, name), text)


def declare_distinct(spark: SparkSession, root: str, name: str, column: str, group: str = "") -> None:
    """Keep exact distinct counts of a column from now on, starting from the rows stored so far."""
    rows = read_stored(spark, root, name)
    distinct_sets.declare_distinct(spark, root, name, column, rows, read_versions(spark, root, name), group)


def _count_dates(rows: DataFrame, table: Table) -> DataFrame:
    return rows.groupBy(table.partition).agg(F.count("*").alias("n"))


def keep_last(df: DataFrame, keys: tuple[str, ...] | list[str], *newest_first: Column) -> DataFrame:
    """One row per key: the first in the given order.

    ``row_number() <= 1`` is planned with a group limit before the shuffle, so a
    key that holds a third of all rows is already down to one row per task when
    it is exchanged.
    """
    order = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def merge_latest(
    current: DataFrame, batch: DataFrame, keys: tuple[str, ...] | list[str], by_sequence: bool = False
) -> DataFrame:
    """Current rows and a batch, one row per key.

    By default the batch replaces what is stored and within it the highest
    ``_seq`` wins. With ``by_sequence`` the highest ``_seq`` wins wherever it
    comes from, so batches may arrive late, twice or out of order.
    """
    tagged = current.withColumn("_incoming", F.lit(0)).unionByName(batch.withColumn("_incoming", F.lit(1)))
    order = [F.col("_seq").desc(), F.col("_incoming").desc()]
    if not by_sequence:
        order.reverse()
    return keep_last(tagged, keys, *order).drop("_incoming")


def upsert(
    spark: SparkSession,
    root: str,
    name: str,
    batch: DataFrame,
    by_sequence: bool = False,
    after_write: Callable[[DataFrame], None] | None = None,
) -> None:
    """Merge a batch into a table, rewriting only the partitions it touches.

    ``after_write`` is given all rows of the dates that were written.

    The merged rows go to a staging table in the shared folder first: a plan must
    not read and overwrite the same files, and a lost executor then costs a
    retry of the copy, not of the merge.
    """
    table = TABLES[name]
    # Read twice below: kept on executor disks so that raw records are parsed once,
    # and parsed again only where an executor was lost.
    batch = batch.select(*_stored_schema(table).names).persist(StorageLevel.DISK_ONLY)
    # At most one entry per calendar week; as a subquery in a partition filter it
    # keeps the scan to the partitions the batch touches.
    touched = batch.agg(F.collect_set(table.partition)).scalar()
    current = read_stored(spark, root, name).filter(F.array_contains(touched, F.col(table.partition)))
    merged = merge_latest(current, batch, table.key, by_sequence)

    try:
        staged, folder = _staged(merged, table)
    finally:
        batch.unpersist()
    try:
        version = time.time_ns()
        value_index.record_values(spark, root, name, staged, version)
        distinct_sets.record_sets(spark, root, name, staged, version)
        _write_partitions(staged, table, root)
        _write_calendar(_count_dates(staged, table), table, root, "append", version)
        if after_write is not None:
            after_write(staged)
    finally:
        _drop_folder(spark, folder)


def _staged(df: DataFrame, table: Table) -> tuple[DataFrame, str]:
    """The rows written to, and read back from, a staging folder of this call's own, and its path."""
    spark = df.sparkSession
    staging = f"{shared_dir(spark)}/epiweave-staging/{table.name}-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    return spark.read.schema(_stored_schema(table)).parquet(staging), staging


def _drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _write_partitions(df: DataFrame, table: Table, root: str, mode: str = "dynamic") -> None:
    columns = value_index.indexed_columns(df.sparkSession, root, table.name)
    if columns:
        # Files of a date hold ranges of the indexed values, and row groups tell them apart; the key
        # splits a value that holds far more rows than others.
        order = dict.fromkeys([table.partition, *columns, *table.key])
        laid_out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    else:
        # Rebalancing keeps files large and splits a week that holds far more rows than others.
        laid_out = df.hint("rebalance", table.partition)
    (
        laid_out.write.mode("overwrite")
        .option("partitionOverwriteMode", mode)
        .partitionBy(table.partition)
        .parquet(table_path(root, table.name))
    )


def replace_snapshot(
    spark: SparkSession,
    root: str,
    name: str,
    batch: DataFrame,
    after_write: Callable[[DataFrame], None] | None = None,
) -> bool:
    """Replace the whole table by the batch, last record per key; ``after_write`` is given its rows.

    An empty batch leaves the table alone and returns False. The batch is staged
    first: a bad record must fail before the old rows are gone.
    """
    table = TABLES[name]
    last = keep_last(batch.select(*_stored_schema(table).names), table.key, F.col("_seq").desc())
    rows, folder = _staged(last, table)
    try:
        if rows.isEmpty():
            return False
        version = time.time_ns()
        value_index.record_values(spark, root, name, rows, version)
        distinct_sets.record_sets(spark, root, name, rows, version)
        _write_partitions(rows, table, root, mode="static")
        _write_calendar(_count_dates(rows, table), table, root, "overwrite", version)
        if after_write is not None:
            after_write(rows)
        return True
    finally:
        _drop_folder(spark, folder)


def append_results(spark: SparkSession, root: str, name: str, rows: DataFrame) -> None:
    """Store forecasts or anomalies; rows of the same key are replaced."""
    upsert(spark, root, name, rows.withColumn("_seq", F.lit(0).cast("long")))


def load_stats(df: DataFrame, distinct: dict[str, str] | None = None) -> DataFrame:
    """Row count and, per entry, a distinct count: {output name: column}."""
    counts = [F.count_distinct(column).alias(name) for name, column in (distinct or {}).items()]
    return df.agg(F.count("*").alias("row_count"), *counts)


def run_query(spark: SparkSession, sql: str, params: list | None = None, **tables: DataFrame) -> DataFrame:
    """Parameterised SQL: '?' marks are bound, {name} marks are DataFrames."""
    return spark.sql(sql, args=params, **tables) if params else spark.sql(sql, **tables)


def execute(spark: SparkSession, sql: str, params: list | None = None) -> None:
    """Parameterised statement run for its effect (INSERT INTO … SELECT)."""
    spark.sql(sql, args=params) if params else spark.sql(sql)
