"""Streaming refresh of the tables and the dashboard summary.

Each run processes the landing files that arrived since the last one. There is
no watermark: a correction of an old week must still land.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from epiweave.plans import states
from epiweave.plans.refresh import rejected_path
from epiweave.plans.stored import stored_summary
from epiweave.schemas import LANDING_TABLES, TABLES
from epiweave.sources.landing import CLEANERS, MALFORMED, accepted, landing_schema, rejected, with_malformed
from epiweave.sources.tables import replace_snapshot, upsert


def landing_stream(spark: SparkSession, landing: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(landing_schema(name)).option("columnNameOfCorruptRecord", MALFORMED)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(f"{landing.rstrip('/')}/{name}")


def stream_upsert(
    raw: DataFrame,
    name: str,
    root: str,
    checkpoint: str,
    interval: str | None = None,
    summary: bool = False,
) -> StreamingQuery:
    """Clean and merge every micro-batch; the highest ``_seq`` of a key wins.

    The merge gives the same table when a batch is replayed or arrives out of
    order, and so do the refused records, which each batch keeps under ``rejected``. A
    wastewater batch is a whole snapshot and replaces the table. Without an interval the
    query takes what is there and stops. With ``summary`` a batch also records the states of the dates
    it touched and refreshes the summary from the states of all, reading no other rows.
    """
    snapshot = name == "wastewater_sites"
    record = (lambda rows: states.write_states(root, name, rows, whole=snapshot)) if summary else None
    if summary:
        states.declare_states(raw.sparkSession, root)

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        cleaned = CLEANERS[name](with_malformed(batch))
        rejected(cleaned).write.mode("overwrite").parquet(f"{rejected_path(root, name)}/batch={batch_id}")
        if snapshot:
            replace_snapshot(session, root, name, accepted(cleaned), after_write=record)
        else:
            upsert(session, root, name, accepted(cleaned), by_sequence=True, after_write=record)
        if summary:
            states.compact_states(session, root, name)
            write_summary(states.merged_summary(session, root), root)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def refresh_summary(spark: SparkSession, root: str) -> None:
    """Recompute the one-row summary from the tables as they are now."""
    write_summary(stored_summary(spark, root), root)


def write_summary(summary: DataFrame, root: str) -> None:
    """Append the summary under a version, so that readers find a whole one at any time.

    Folders of old versions may be removed.
    """
    summary.coalesce(1).write.parquet(f"{root.rstrip('/')}/dashboard_summary/version={time.time_ns()}")


def read_summary(spark: SparkSession, root: str) -> DataFrame:
    """The latest summary."""
    versions = spark.read.parquet(f"{root.rstrip('/')}/dashboard_summary")
    return versions.filter(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")


def stream_summary(raw: DataFrame, name: str, root: str, checkpoint: str, interval: str | None = None):
    """Merge every micro-batch, then refresh the summary from the states of the dates."""
    return stream_upsert(raw, name, root, checkpoint, interval, summary=True)


def stream_all(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoints: str,
    interval: str | None = None,
    summary: bool = False,
) -> list[StreamingQuery]:
    """A stream for each landing folder; wait for or stop the queries returned.

    With ``summary`` each of them keeps the one summary of all tables fresh.
    """
    return [
        stream_upsert(
            landing_stream(spark, landing, name), name, root, f"{checkpoints.rstrip('/')}/{name}", interval, summary
        )
        for name in LANDING_TABLES
    ]
