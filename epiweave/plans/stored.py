"""Reads of stored tables that take their dates from the calendar."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.operators import snapshot
from epiweave.operators.snapshot import newest_dates
from epiweave.plans.dashboard import dashboard_summary
from epiweave.schemas import LANDING_TABLES, TABLES
from epiweave.sources import distinct_sets, value_index
from epiweave.sources.tables import read_calendar, read_table, read_versions


def newest(spark: SparkSession, root: str, name: str, days: int = 0) -> DataFrame:
    """Rows of a table's newest date and of the ``days`` before it.

    The date is a subquery over the calendar in a partition filter, so no other date's
    files are opened, also where an operator looks for the newest date in these rows again.
    """
    date = TABLES[name].partition
    last = read_calendar(spark, root, name).agg(F.max(date)).scalar()
    return read_table(spark, root, name).filter(F.col(date) >= F.date_sub(last, days))


def newest_rows(spark: SparkSession, root: str, name: str, rows: int) -> DataFrame:
    """Rows of the newest dates that together hold at least ``rows`` rows."""
    date = TABLES[name].partition
    return newest_dates(read_table(spark, root, name), date, rows, read_calendar(spark, root, name))


def rows_of_value(spark: SparkSession, root: str, name: str, column: str, value: str) -> DataFrame:
    """Rows that hold a value in an indexed column (``declare_lookup``); only its dates are opened."""
    days = value_index.days_of_value(spark, root, name, column, value)
    rows = value_index.on_days(read_table(spark, root, name), TABLES[name].partition, days)
    return rows.filter(F.col(column) == value)


def rows_like(spark: SparkSession, root: str, name: str, column: str, part: str) -> DataFrame:
    """Rows whose indexed column holds a LIKE fragment, wildcards kept; only the dates of such values are opened."""
    days = value_index.days_like(spark, root, name, column, part)
    rows = value_index.on_days(read_table(spark, root, name), TABLES[name].partition, days)
    return rows.filter(F.col(column).like(f"%{part}%"))


def last_rows(spark: SparkSession, root: str, name: str, column: str, rows: int) -> DataFrame:
    """Rows of the dates that hold the newest ``rows`` rows of each value of an indexed column."""
    days = value_index.days_of_last_rows(spark, root, name, column, rows, read_versions(spark, root, name))
    return value_index.on_days(read_table(spark, root, name), TABLES[name].partition, days)


def stored_county(spark: SparkSession, root: str, fips: str) -> DataFrame:
    """Readings of one county over all dates, from its own dates only."""
    return snapshot.wastewater_county(rows_of_value(spark, root, "wastewater_sites", "county_fips", fips), fips)


def stored_history(spark: SparkSession, root: str, weeks: int = 52) -> DataFrame:
    """The last ``weeks`` weeks of each place; dates on which no place needs one stay closed."""
    return snapshot.ari_history(last_rows(spark, root, "ari_activity", "geography", weeks), weeks=weeks)


def stored_summary(spark: SparkSession, root: str) -> DataFrame:
    """The dashboard summary from the newest date of each table; only places are read over all weeks."""
    return dashboard_summary(*(newest(spark, root, n) for n in LANDING_TABLES), read_table(spark, root, "ari_activity"))


def calendar_totals(spark: SparkSession, root: str) -> DataFrame:
    """Rows and newest date of each loaded table."""
    totals = [
        read_calendar(spark, root, name).agg(
            F.lit(name).alias("table_name"), F.sum("n").alias("row_count"), F.max(TABLES[name].partition).alias("newest")
        )
        for name in LANDING_TABLES
    ]
    return reduce(DataFrame.unionByName, totals)


def stored_distinct(spark: SparkSession, root: str, name: str, column: str, group: str = "", days: int | None = None) -> DataFrame:
    """Distinct values (``n``) of a column, per value of ``group`` (``part``) if it was declared so, from stored bitmaps.

    Over all dates, or the newest one and the ``days`` before it. No row of the table is read.
    """
    versions = read_versions(spark, root, name)
    if days is not None:
        date = TABLES[name].partition
        versions = versions.filter(F.col(date) >= F.date_sub(versions.agg(F.max(date)).scalar(), days))
    sets = distinct_sets.read_sets(spark, root, name, column, versions, group)
    return distinct_sets.count_sets(sets, *(["part"] if group else []))


def stored_load_stats(spark: SparkSession, root: str, name: str, distinct: dict[str, str]) -> DataFrame:
    """As ``tables.load_stats``: rows from the calendar, distinct counts ({output name: column}) from bitmaps."""
    counts = [stored_distinct(spark, root, name, column).scalar().alias(out) for out, column in distinct.items()]
    total = read_calendar(spark, root, name).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar().alias("row_count")
    return spark.range(1).select(total, *counts)


def stored_state_counts(spark: SparkSession, root: str, days: int | None = None) -> DataFrame:
    """Sites and counties of each state, over all dates or the newest ones."""
    sites, counties = (
        stored_distinct(spark, root, "wastewater_sites", column, "wwtp_jurisdiction", days).withColumnRenamed("n", out)
        for column, out in (("wwtp_id", "sites"), ("county_fips", "counties"))
    )
    return sites.join(counties.withColumnRenamed("part", "other"), F.col("part").eqNullSafe(F.col("other"))).select(
        F.col("part").alias("state"), "sites", "counties"
    )
