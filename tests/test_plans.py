"""What the plans must and must not contain."""

import datetime as dt
import os

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from epiweave.operators import snapshot
from epiweave.plans import registry
from epiweave.session import shared_dir
from epiweave.sources import tables

WRITING = {n for n in registry.QUERIES if n.startswith(("forecast", "importances", "stream", "refresh", "stored"))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - WRITING))
def test_no_python_rows_and_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    for unwanted in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text


@pytest.mark.parametrize("name", ["dedup_last", "upsert_hosp", "ari_history"])
def test_ranked_filters_limit_groups_before_the_exchange(spark, name):
    text = plan(entry.queries()[name](spark, SMALL))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_read_only_needed_columns(spark):
    text = plan(entry.queries()["hosp_trends"](spark, SMALL))
    assert "l_extendedprice" not in text and "l_orderkey" not in text
    # The cumulative rate is not asked for, so its window is not computed.
    assert "Window" not in text


def test_top_k_is_a_bounded_sort(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["hosp_recent"](spark, SMALL))


def test_date_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "ww")
    spark.range(5).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date_end"), "id").write.parquet(path)
    text = plan(snapshot.latest(spark.read.parquet(path), "date_end", "2024-01-03"))
    assert "PushedFilters: [IsNotNull(date_end), EqualTo(date_end,2024-01-03)]" in text


def test_latest_reads_one_partition(spark, root):
    tables.declare_tables(spark, root, ("ari_activity",))
    data = [(dt.date(2024, 1, 6) + dt.timedelta(weeks=w), f"P{p}", "Low", "1", 0) for w in range(10) for p in range(5)]
    frame = spark.createDataFrame(data, "week_end date, geography string, label string, buildnumber string, _seq long")
    tables.upsert(spark, root, "ari_activity", frame)
    got = snapshot.latest(tables.read_table(spark, root, "ari_activity"), "week_end")
    assert "PartitionFilters: [isnotnull(week_end" in plan(got)
    files = {os.path.dirname(r.f) for r in got.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == 1
    assert got.count() == 5


def test_joined_dimensions_are_the_build_side(spark):
    text = plan(entry.queries()["hosp_trends"](spark, SMALL))
    assert "BuildLeft" not in text


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    else:
        assert shared_dir(spark) == shared_dir(spark)


def test_each_run_writes_into_a_folder_of_its_own(spark):
    sources = registry.sources_of(spark, SMALL)
    assert registry.work_folder(sources, "x") != registry.work_folder(sources, "x")
