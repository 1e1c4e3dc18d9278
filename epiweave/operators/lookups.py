"""Dimension look-ups: codes, coordinates and networks.

The dimensions have at most one row per place or network. No broadcast is
forced: the planner broadcasts a side whose size it knows to be small and
otherwise joins by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.functions.scalars import is_available, marker_size, risk_level


def with_state_code(df: DataFrame, states: DataFrame) -> DataFrame:
    """Inner look-up: rows of unknown geographies drop."""
    return df.join(states.select("geography", "code"), "geography")


def with_code_or_name(df: DataFrame, states: DataFrame, column: str = "state") -> DataFrame:
    """Left look-up: an unknown state keeps its own name as the code."""
    codes = states.select(F.col("geography").alias(column), "code")
    return df.join(codes, column, "left").withColumn("code", F.coalesce("code", column))


def state_of_code(df: DataFrame, states: DataFrame) -> DataFrame:
    """Reverse look-up from code to geography; unknown codes drop."""
    return df.join(states.select("code", "geography"), "code")


def map_points(ari_latest: DataFrame, states: DataFrame) -> DataFrame:
    """Latest labels with coordinates, level, marker size and ring flag."""
    places = states.filter("lat IS NOT NULL").select("geography", "lat", "lng")
    return (
        ari_latest.join(places, "geography")
        .withColumn("level", risk_level("label"))
        .select(
            F.col("geography").alias("name"),
            "label",
            "level",
            "lat",
            "lng",
            marker_size("level").alias("size"),
            (F.col("level") >= 4).alias("ring"),
        )
    )


def rank_by_level(ari_latest: DataFrame) -> DataFrame:
    """Available labels, most severe first."""
    return (
        ari_latest.filter(is_available("label"))
        .withColumn("level", risk_level("label", default=0))
        .orderBy(F.col("level").desc(), "geography")
    )


def with_virus_name(df: DataFrame, networks: DataFrame) -> DataFrame:
    """Adds the virus name of each surveillance network; unknown ones drop."""
    return df.join(networks, "surveillance_network")
