"""Dimension look-ups and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.functions import scalars as S
from epiweave.operators import lookups, snapshot
from epiweave.plans.registry import half_up, query, tidied
from epiweave.schemas import network_dimension


@query(
    "map_points",
    """SELECT geography AS name, label, coalesce(level, 1) AS level, lat, lng,
       round(CASE WHEN level = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) + coalesce(level, 1) *
         CAST(0.15 AS DOUBLE) END, 8) + 0.0 AS size, coalesce(level, 1) >= 4 AS ring
       FROM places_latest JOIN states USING (geography)""",
    "ari",
    "places",
    "states",
)
def _map_points(t):
    return tidied(lookups.map_points(snapshot.latest(t.labelled_places, "week_end"), t.state_dim), "size")


@query(
    "state_codes",
    "SELECT geography, week_end, label, code FROM places JOIN states USING (geography)",
    "ari",
    "places",
    "states",
)
def _state_codes(t):
    return lookups.with_state_code(t.labelled_places, t.state_dim)


@query(
    "state_fallback",
    """SELECT geography AS state, week_end, label, coalesce(code, geography) AS code
       FROM places LEFT JOIN states USING (geography)""",
    "ari",
    "places",
    "states",
)
def _state_fallback(t):
    return lookups.with_code_or_name(t.labelled_places.withColumnRenamed("geography", "state"), t.state_dim)


@query(
    "state_reverse",
    "SELECT code, week_end, label, geography FROM places JOIN states USING (geography)",
    "ari",
    "places",
    "states",
)
def _state_reverse(t):
    coded = lookups.with_code_or_name(t.labelled_places.withColumnRenamed("geography", "state"), t.state_dim)
    return lookups.state_of_code(coded.drop("state"), t.state_dim)


@query(
    "label_rank",
    """SELECT geography, label, coalesce(level, 0) AS level FROM ari_latest WHERE label <> 'Data Unavailable'""",
    "ari",
)
def _label_rank(t):
    return lookups.rank_by_level(snapshot.latest(t.ari, "week_end")).select("geography", "label", "level")


@query(
    "bands",
    f"""SELECT wwtp_id, date_end, CASE WHEN percentile >= 80 THEN 'Very High' WHEN percentile >= 60 THEN 'High'
         WHEN percentile >= 40 THEN 'Moderate' WHEN percentile >= 20 THEN 'Low' ELSE 'Minimal' END AS band,
       CASE WHEN ptc_15d > 0 THEN 'up' ELSE 'down' END AS direction, {half_up("abs(ptc_15d)", 0)} AS magnitude,
       CASE WHEN percentile > 50 THEN 'high' WHEN percentile > 20 THEN 'moderate' ELSE 'safe' END AS overflow
       FROM ww""",
    "ww",
)
def _bands(t):
    return t.ww.select(
        "wwtp_id",
        "date_end",
        S.percentile_band("percentile").alias("band"),
        S.trend_direction("ptc_15d").alias("direction"),
        S.trend_magnitude("ptc_15d").alias("magnitude"),
        S.overflow_band("percentile").alias("overflow"),
    )


@query(
    "banners",
    """SELECT week_end, high, CASE WHEN high >= 5 THEN 'danger' WHEN high > 0 THEN 'warning' ELSE 'none' END AS banner,
       CASE WHEN high > 3 THEN 'elevated' ELSE 'low' END AS status FROM (
         SELECT week_end, count(*) FILTER (label IN ('High', 'Very High')) AS high FROM ari GROUP BY 1)""",
    "ari",
)
def _banners(t):
    weekly = t.ari.groupBy("week_end").agg(F.count_if(F.col("label").isin("High", "Very High")).alias("high"))
    return weekly.select(
        "week_end", "high", S.banner_band("high").alias("banner"), S.overall_status("high").alias("status")
    )


@query(
    "short_names",
    """SELECT surveillance_network, replace(replace(surveillance_network, '-NET', ''), 'Surv', '') AS short_name,
       lower(replace(replace(surveillance_network, '-', '_'), ' ', '_')) AS safe_name,
       CASE surveillance_network WHEN 'COVID-NET' THEN 'COVID-19' WHEN 'FluSurv-NET' THEN 'Influenza' ELSE 'RSV' END
         AS virus, count(*) AS n FROM hosp GROUP BY 1""",
    "hosp",
)
def _short_names(t):
    counted = t.hosp.groupBy("surveillance_network").agg(F.count("*").alias("n"))
    return lookups.with_virus_name(counted, network_dimension(t.spark)).select(
        "surveillance_network",
        S.short_network("surveillance_network").alias("short_name"),
        S.safe_name("surveillance_network").alias("safe_name"),
        "virus",
        "n",
    )


@query(
    "label_slugs",
    """SELECT label, replace(lower(label), ' ', '-') AS slug, count(*) AS n FROM ari GROUP BY 1""",
    "ari",
)
def _label_slugs(t):
    return t.ari.groupBy("label").agg(F.count("*").alias("n")).select("label", S.label_slug("label").alias("slug"), "n")


@query(
    "null_defaults",
    """SELECT wwtp_id, date_end, coalesce(nullif(county_names, 'County_3'), 'Unknown County') AS county,
       coalesce(nullif(percentile, 7), 0) AS percentile FROM ww""",
    "ww",
)
def _null_defaults(t):
    # One county and one percentile are blanked first, so that the defaults are met.
    sites = t.ww.select(
        "wwtp_id",
        "date_end",
        F.nullif("county_names", F.lit("County_3")).alias("county"),
        F.nullif("percentile", F.lit(7.0)).alias("percentile"),
    )
    return snapshot.with_display_defaults(sites)
