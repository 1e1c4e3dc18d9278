"""Streaming upsert and summary refresh."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.plans.registered.aggregations import DASHBOARD_SQL, flat_dashboard
from epiweave.plans import states, stored
from epiweave.plans.registered.ingest import raw_positivity, stage_landing
from epiweave.plans.registry import Sources, query, work_folder
from epiweave.sources import tables
from epiweave.streaming import refresh as streaming


def _event_stream(t: Sources) -> DataFrame:
    """The events table as a stream of raw records, one batch per file."""
    source = t.table("events")
    # The bracket makes the path a pattern, which matches a single file as well as a folder.
    return (
        t.spark.readStream.schema(source.schema)
        .option("maxFilesPerTrigger", 1)
        .parquet(f"{t.folder}/events.parque[t]")
    )


@query(
    "stream_upsert",
    """SELECT CAST(ts AS DATE) AS week_end, CASE event_type WHEN 'click' THEN 'COVID-19' WHEN 'view' THEN 'Influenza'
         WHEN 'purchase' THEN 'RSV' ELSE event_type END AS pathogen, arg_max(value, event_id) AS percent_test_positivity
       FROM events GROUP BY 1, 2""",
)
def _stream_upsert(t):
    folder = work_folder(t, "stream")
    tables.declare_tables(t.spark, folder, ("test_positivity",))
    raw = raw_positivity(_event_stream(t))
    streaming.stream_upsert(raw, "test_positivity", folder, f"{folder}/checkpoint").awaitTermination()
    return tables.read_table(t.spark, folder, "test_positivity").select(
        "week_end", "pathogen", "percent_test_positivity"
    )


@query(
    "stream_summary",
    DASHBOARD_SQL,
    "ari",
    "hosp",
    "streamed",
    "ww",
)
def _stream_summary(t):
    folder = work_folder(t, "summary")
    tables.declare_tables(t.spark, folder)
    zero = F.lit(0).cast("long")
    for name, df in (("ari_activity", t.ari), ("hospitalization_rates", t.hosp), ("wastewater_sites", t.ww)):
        tables.upsert(t.spark, folder, name, df.withColumn("_seq", zero))
    raw = raw_positivity(_event_stream(t))
    streaming.stream_summary(raw, "test_positivity", folder, f"{folder}/checkpoint").awaitTermination()
    return flat_dashboard(streaming.read_summary(t.spark, folder))


def _loads(events: DataFrame, path: str, loads: int = 3) -> Iterator[None]:
    """Append the records in ``loads`` parts of all dates, each written by all tasks; yields after each."""
    for i in range(loads):
        events.filter(F.col("event_id") % loads == i).write.mode("append").parquet(path)
        yield


@query("stream_states", DASHBOARD_SQL, "ari", "hosp", "streamed", "ww")
def _stream_states(t):
    # Three batches of records of all dates: each corrects the weeks of the ones before.
    folder = work_folder(t, "states")
    tables.declare_tables(t.spark, folder)
    zero = F.lit(0).cast("long")
    states.declare_states(t.spark, folder)
    for name, df in (("ari_activity", t.ari), ("hospitalization_rates", t.hosp)):
        tables.upsert(
            t.spark, folder, name, df.withColumn("_seq", zero), after_write=partial(states.write_states, folder, name)
        )
    whole = partial(states.write_states, folder, "wastewater_sites", whole=True)
    tables.replace_snapshot(t.spark, folder, "wastewater_sites", t.ww.withColumn("_seq", zero), after_write=whole)
    events = t.table("events")
    for _ in _loads(events, f"{folder}/events"):
        # The files of a load, however many, are one batch.
        stream = t.spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        streaming.stream_summary(
            raw_positivity(stream), "test_positivity", folder, f"{folder}/checkpoint"
        ).awaitTermination()
    return flat_dashboard(streaming.read_summary(t.spark, folder))


@query(
    "stream_refresh",
    """SELECT 'ari_activity' AS table_name, CAST(count(*) AS BIGINT) AS row_count, max(week_end) AS newest FROM ari UNION ALL
       SELECT 'hospitalization_rates', count(*), max(week_ending_date) FROM (SELECT DISTINCT surveillance_network,
         week_ending_date, age_group, sex, race_ethnicity, site FROM hosp) UNION ALL
       SELECT 'test_positivity', count(*), max(week_end) FROM pos UNION ALL
       SELECT 'wastewater_sites', count(*), max(date_end) FROM ww""",
    "ari",
    "hosp",
    "pos",
    "ww",
)
def _stream_refresh(t):
    folder = work_folder(t, "stream-all")
    stage_landing(t, f"{folder}/landing")
    tables.declare_tables(t.spark, f"{folder}/tables")
    for running in streaming.stream_all(t.spark, f"{folder}/landing", f"{folder}/tables", f"{folder}/checkpoints"):
        running.awaitTermination()
    return stored.calendar_totals(t.spark, f"{folder}/tables")
