"""Distinct counts from stored bitmaps against plain counts of the rows."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epiweave.plans import stored
from epiweave.schemas import TABLES
from epiweave.sources import distinct_sets, tables

NAME = "wastewater_sites"
FIRST = dt.date(2024, 1, 6)


def sites(spark, *records):
    data = [
        (state, plant, "c", fips, 10, FIRST + dt.timedelta(weeks=w), FIRST + dt.timedelta(weeks=w), 1.0, 2.0, 3.0, "no", None, i)
        for i, (w, state, plant, fips) in enumerate(records)
    ]
    return spark.createDataFrame(data, tables._stored_schema(TABLES[NAME]))


def declared(spark, root):
    tables.declare_tables(spark, root, (NAME,))
    for column in ("wwtp_id", "county_fips"):
        for group in ("", "wwtp_jurisdiction"):
            tables.declare_distinct(spark, root, NAME, column, group)


def check(spark, root):
    table = tables.read_table(spark, root, NAME)
    columns = {"sites": "wwtp_id", "counties": "county_fips"}
    found = stored.stored_load_stats(spark, root, NAME, columns)
    assert rows(found) == rows(tables.load_stats(table, columns))
    by_state = table.groupBy(F.col("wwtp_jurisdiction").alias("state")).agg(
        F.count_distinct("wwtp_id").alias("sites"), F.count_distinct("county_fips").alias("counties")
    )
    assert rows(stored.stored_state_counts(spark, root)) == rows(by_state)
    newest = table.filter(F.col("date_end") == table.agg(F.max("date_end")).scalar())
    counties = stored.stored_distinct(spark, root, NAME, "county_fips", days=0).first().n
    assert counties == newest.agg(F.count_distinct("county_fips")).first()[0]
    return found.first()


def test_random_loads_with_corrections(spark, root):
    declared(spark, root)
    assert tuple(check(spark, root)) == (0, 0, 0)
    rng = random.Random(5)
    for _ in range(4):
        batch = [
            (rng.randrange(5), rng.choice(["Ohio", "Utah", None]), f"p{rng.randrange(30)}", rng.choice([None, "", *map(str, range(9))]))
            for _ in range(40)
        ]
        tables.upsert(spark, root, NAME, sites(spark, *batch))
        check(spark, root)
    # Replacing the table forgets all dates before.
    tables.replace_snapshot(spark, root, NAME, sites(spark, (9, "Iowa", "q", "77"), (9, "Iowa", "r", "77"), (9, None, "s", None)))
    assert tuple(check(spark, root)) == (3, 3, 1)


def test_corrected_value_no_longer_counts_and_late_declaration(spark, root):
    tables.declare_tables(spark, root, (NAME,))
    tables.upsert(spark, root, NAME, sites(spark, (0, "Ohio", "p", "1"), (1, "Ohio", "p", "1"), (1, "Ohio", "q", "2")))
    for column in ("wwtp_id", "county_fips"):
        tables.declare_distinct(spark, root, NAME, column)
        tables.declare_distinct(spark, root, NAME, column, "wwtp_jurisdiction")
    assert check(spark, root).counties == 2
    tables.declare_distinct(spark, root, NAME, "county_fips")  # again: nothing changes
    tables.upsert(spark, root, NAME, sites(spark, (1, "Ohio", "q", "1")))
    assert check(spark, root).counties == 1


def test_more_values_than_a_bucket_holds(spark, root):
    tables.declare_tables(spark, root, (NAME,))
    one = sites(spark, (0, "Ohio", "p", "1"))
    many = spark.range(70_000).crossJoin(one).withColumn("wwtp_id", F.col("id").cast("string")).drop("id")
    many = many.withColumn("county_fips", (F.col("wwtp_id").cast("long") % 40_000).cast("string"))
    tables.upsert(spark, root, NAME, many)
    for column in ("wwtp_id", "county_fips"):
        for group in ("", "wwtp_jurisdiction"):
            tables.declare_distinct(spark, root, NAME, column, group)
    row = check(spark, root)
    assert (row.row_count, row.sites, row.counties) == (70_000, 70_000, 40_000)
    ids = spark.read.parquet(distinct_sets._path(root, NAME, "wwtp_id", "ids"))
    assert tuple(ids.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()) == (1, 70_000, 70_000)


def test_load_that_dies_before_the_calendar_counts_nothing(spark, root, monkeypatch):
    declared(spark, root)
    tables.upsert(spark, root, NAME, sites(spark, (0, "Ohio", "p", "1"), (1, "Utah", "q", "2")))

    def dies(*_):
        raise OSError("disk full")

    with monkeypatch.context() as m:
        m.setattr(tables, "_write_partitions", dies)
        with pytest.raises(OSError, match="disk full"):
            tables.upsert(spark, root, NAME, sites(spark, (1, "Utah", "r", "3"), (2, "Utah", "s", "4")))
    assert tuple(check(spark, root)) == (2, 2, 2)
    tables.upsert(spark, root, NAME, sites(spark, (1, "Utah", "r", "3"), (2, "Utah", "s", "4")))
    assert tuple(check(spark, root)) == (4, 4, 4)


def test_plan_reads_no_rows_of_the_table(spark, root):
    declared(spark, root)
    tables.upsert(spark, root, NAME, sites(spark, (0, "Ohio", "p", "1")))
    for df in (
        stored.stored_load_stats(spark, root, NAME, {"sites": "wwtp_id", "counties": "county_fips"}),
        stored.stored_state_counts(spark, root),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan
        assert f"{root}/{NAME}" not in plan.replace(f"distinct_sets/{NAME}", "").replace(f"calendar/{NAME}", "")
