"""Partial states of the dashboard summary: one row per table and date, merged without reading the tables.

A load rewrites whole dates, so it replaces their states and leaves all others alone. States are
appended under a version; of a date the newest counts. A version that is ``whole`` tells all dates
of its table: older ones no longer count, and those before the last but one whole version are removed.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.plans.dashboard import headline
from epiweave.schemas import LANDING_TABLES, TABLES
from epiweave.sources.tables import read_table

_FIGURES = {
    "risks": "array<struct<label:string,count:bigint>>",
    "places": "array<string>",
    "positivity": "array<struct<pathogen:string,percent_test_positivity:double>>",
    "ww": "struct<sites:bigint,counties:bigint,avg_percentile:double,latest_date:date,readings:bigint>",
}
_SCHEMA = ", ".join(["day date", "whole boolean", *(f"{name} {kind}" for name, kind in _FIGURES.items()), "version long"])
_NO_SITES = "struct(0, 0, null, null, 0)"
#: Versions of a table after which they are put together.
MOST_VERSIONS = 64


def states_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/summary_states/{name}"


def states_of(rows: DataFrame, name: str) -> DataFrame:
    """The state of every date in ``rows``, which must hold all rows of their dates.

    Lists have one entry per label, place or pathogen of a date; figures of other tables are null.
    """
    date = TABLES[name].partition
    day = F.col(date).alias("day")
    if name == "ari_activity":
        by_label = rows.groupBy(day, "label").agg(F.count("*").alias("n"), F.collect_set("geography").alias("places"))
        # Negated counts sort the largest first, then by label.
        ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "label")))
        found = by_label.groupBy("day").agg(
            F.transform(ordered, lambda e: F.struct(e["label"].alias("label"), (-e["less"]).alias("count"))).alias("risks"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
        )
    elif name == "test_positivity":
        found = rows.groupBy(day).agg(
            F.sort_array(F.collect_list(F.struct("pathogen", "percent_test_positivity"))).alias("positivity")
        )
    elif name == "wastewater_sites":
        found = rows.groupBy(day).agg(
            F.struct(
                F.count_distinct("wwtp_id").alias("sites"),
                F.count_distinct("county_fips").alias("counties"),
                F.avg("percentile").alias("avg_percentile"),
                F.max(date).alias("latest_date"),
                F.count("*").alias("readings"),
            ).alias("ww")
        )
    else:
        found = rows.select(day).distinct()
    given = set(found.columns)
    figures = [(F.col(c) if c in given else F.lit(None)).cast(kind).alias(c) for c, kind in _FIGURES.items()]
    return found.select("day", *figures)


def write_states(root: str, name: str, rows: DataFrame, whole: bool = False) -> None:
    """Record the states of the dates in ``rows``; with ``whole`` they are all dates of the table."""
    _append(root, name, states_of(rows, name), whole)


def _append(root: str, name: str, states: DataFrame, whole: bool) -> int:
    version = time.time_ns()
    path = f"{states_path(root, name)}/version={version}"
    states.withColumn("whole", F.lit(whole)).coalesce(1).write.parquet(path)
    return version


def read_states(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(day and figures) of every date of a table, as the loads so far left it."""
    written = spark.read.schema(_SCHEMA).parquet(states_path(root, name))
    last_whole = written.filter("whole").agg(F.max("version")).scalar()
    current = written.filter(F.col("version") >= F.coalesce(last_whole, F.lit(0)))
    newest = F.max_by(F.struct(*_FIGURES), "version").alias("s")
    return current.groupBy("day").agg(newest).select("day", "s.*")


def declare_states(spark: SparkSession, root: str, names: tuple[str, ...] = LANDING_TABLES) -> None:
    """States of the tables as they are, where there are none yet; tables are read here and never again."""
    for name in names:
        if not _versions(spark, root, name):
            write_states(root, name, read_table(spark, root, name), whole=True)


def compact_states(spark: SparkSession, root: str, name: str, most: int = MOST_VERSIONS) -> None:
    """Put a table's states together once it has more than ``most`` versions.

    The new version is whole before older ones go, and those a reader may have listed stay until the next time.
    """
    versions = _versions(spark, root, name)
    if len(versions) <= most:
        return
    written = spark.read.schema(_SCHEMA).parquet(states_path(root, name))
    before = written.filter("whole").agg(F.max("version")).first()[0] or 0
    _append(root, name, read_states(spark, root, name), whole=True)
    for version in versions:
        if version < before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{states_path(root, name)}/version={version}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Versions written, oldest first, from the names of their folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(states_path(root, name))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(f.removeprefix("version=")) for f in folders if f.startswith("version="))


def merged_summary(spark: SparkSession, root: str) -> DataFrame:
    """The dashboard summary from the states of all dates; no row of a table is read."""
    states = {name: read_states(spark, root, name) for name in LANDING_TABLES}

    def last(name: str, figure: str) -> Column:
        return states[name].agg(F.max_by(figure, "day")).scalar()

    def newest(name: str) -> Column:
        return states[name].agg(F.max("day")).scalar()

    places = states["ari_activity"].select(F.explode("places").alias("place")).agg(F.count_distinct("place")).scalar()
    return headline(
        spark.range(1).select(
            F.coalesce(last("ari_activity", "risks"), F.array()).alias("risk_distribution"),
            newest("ari_activity").alias("latest_ari"),
            newest("hospitalization_rates").alias("latest_hospitalization"),
            newest("test_positivity").alias("latest_positivity_date"),
            F.coalesce(last("test_positivity", "positivity"), F.array()).alias("latest_positivity"),
            places.alias("total_states_tracked"),
            F.coalesce(last("wastewater_sites", "ww"), F.expr(f"CAST({_NO_SITES} AS {_FIGURES['ww']})")).alias("ww"),
        )
    )
