"""Batch refresh: landing records into the four tables."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.schemas import LANDING_TABLES
from epiweave.sources.landing import (
    CLEANERS,
    MALFORMED,
    accepted,
    iso_date,
    read_landing,
    recent_only,
    rejected,
    with_malformed,
)
from epiweave.sources.tables import read_stored, replace_snapshot, upsert

log = logging.getLogger(__name__)


def load_batch(spark: SparkSession, root: str, name: str, raw: DataFrame) -> None:
    """Clean one raw batch and merge it: wastewater replaces, the others upsert.

    Refused records are kept beside the tables, under ``rejected``, with their raw text.
    """
    cleaned = CLEANERS[name](with_malformed(raw))
    quarantine(cleaned, rejected_path(root, name))
    rows = accepted(cleaned)
    if name == "wastewater_sites":
        replace_snapshot(spark, root, name, rows)
    else:
        upsert(spark, root, name, rows)


def refresh_all(spark: SparkSession, landing: str, root: str, as_of: str, wastewater_days: int = 365) -> bool:
    """Load all four tables in order.

    The first failure stops the run and returns False; tables loaded before it
    keep their new rows.
    """
    for name in LANDING_TABLES:
        try:
            raw = read_landing(spark, landing, name)
            if name == "wastewater_sites":
                # The date filter runs on the raw stamp, before cleaning; a malformed line has none and is refused later.
                broken = F.when(F.col(MALFORMED).isNotNull(), F.lit(as_of).cast("date"))
                dated = raw.withColumn("_day", broken.otherwise(iso_date(F.col("date_end"))))
                raw = recent_only(dated, as_of, wastewater_days, "_day").drop("_day")
            load_batch(spark, root, name, raw)
        except Exception:
            log.exception("load of %s failed", name)
            return False
        log.info("loaded %s", name)
    return True


def rejected_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/rejected/{name}"


def quarantine(cleaned: DataFrame, path: str) -> None:
    """Keep refused records, with their reason, for inspection."""
    rejected(cleaned).write.mode("append").partitionBy("reject_reason").parquet(path)


def table_counts(spark: SparkSession, root: str) -> DataFrame:
    """Row count of each loaded table."""
    counts = [
        read_stored(spark, root, name).agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"))
        for name in LANDING_TABLES
    ]
    return reduce(DataFrame.unionByName, counts)
