"""Grouped statistics and the dashboard summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiweave.operators import aggregates, snapshot
from epiweave.plans.dashboard import dashboard_summary
from epiweave.plans.registry import half_up, query, tidied, weekly_series
from epiweave.sources import tables


DASHBOARD_SQL = """
SELECT (SELECT string_agg(label || '=' || n, '; ' ORDER BY n DESC, label)
          FROM (SELECT label, count(*) AS n FROM ari_latest GROUP BY 1)) AS risk_distribution,
       (SELECT max(week_end) FROM ari) AS latest_ari,
       (SELECT max(week_ending_date) FROM hosp) AS latest_hospitalization,
       (SELECT max(week_end) FROM pos) AS latest_positivity_date,
       (SELECT string_agg(pathogen || '=' || printf('%.4f', percent_test_positivity), '; ' ORDER BY pathogen)
          FROM pos_latest) AS latest_positivity,
       (SELECT count(DISTINCT geography) FROM ari) AS total_states_tracked,
       (SELECT count(*) FROM ari_latest WHERE label IN ('High', 'Very High')) AS high_risk_states,
       (SELECT count(DISTINCT wwtp_id) FROM ww_latest) AS wastewater_sites,
       (SELECT count(DISTINCT county_fips) FROM ww_latest) AS wastewater_counties,
       (SELECT round(avg(percentile), 8) + 0.0 FROM ww_latest) AS wastewater_avg_percentile,
       (SELECT max(date_end) FROM ww_latest) AS wastewater_latest"""


def flat_dashboard(df: DataFrame) -> DataFrame:
    """Lists as text, so that the row compares by value."""

    def text(column: str, key: str, value: Callable[[Column], Column]) -> Column:
        return F.concat_ws("; ", F.transform(column, lambda e: F.concat(e[key], F.lit("="), value(e))))

    return tidied(df, "wastewater_avg_percentile").withColumns(
        {
            "risk_distribution": text("risk_distribution", "label", lambda e: e["count"].cast("string")),
            "latest_positivity": text(
                "latest_positivity", "pathogen", lambda e: F.format_string("%.4f", e["percent_test_positivity"])
            ),
        }
    )


@query("dashboard_summary", DASHBOARD_SQL, "ari", "hosp", "pos", "ww")
def _dashboard_summary(t):
    return flat_dashboard(dashboard_summary(t.ari, t.hosp, t.pos, t.ww))


@query(
    "latest_dates",
    """SELECT (SELECT max(week_end) FROM ari) AS ari_activity, (SELECT max(week_ending_date) FROM hosp)
       AS hospitalizations, (SELECT max(week_end) FROM pos) AS test_positivity""",
    "ari",
    "hosp",
    "pos",
)
def _latest_dates(t):
    return aggregates.latest_dates(t.ari, t.hosp, t.pos)


@query(
    "state_counts",
    """SELECT (SELECT count(DISTINCT geography) FROM ari) AS total_states_tracked,
       (SELECT count(*) FROM ari_latest WHERE label IN ('High', 'Very High')) AS high_risk_states""",
    "ari",
)
def _state_counts(t):
    return aggregates.state_counts(t.ari)


@query(
    "ww_summary",
    """SELECT count(DISTINCT wwtp_id) AS sites, count(DISTINCT county_fips) AS counties,
       round(avg(percentile), 8) + 0.0 AS avg_percentile, max(date_end) AS latest_date, count(*) AS readings
       FROM ww_latest""",
    "ww",
)
def _ww_summary(t):
    return tidied(aggregates.wastewater_summary(t.ww), "avg_percentile")


@query(
    "ww_states",
    """SELECT wwtp_jurisdiction AS state, count(DISTINCT wwtp_id) AS sites, count(DISTINCT county_fips) AS counties,
       round(avg(percentile), 8) + 0.0 AS avg_percentile, round(avg(ptc_15d), 8) + 0.0 AS avg_pct_change
       FROM ww_latest GROUP BY 1""",
    "ww",
)
def _ww_states(t):
    return tidied(aggregates.wastewater_states(t.ww), "avg_percentile", "avg_pct_change")


@query(
    "one_series",
    """SELECT virus, date, round(rate, 8) + 0.0 AS rate FROM indexed WHERE virus = 'COVID-NET' AND points >= 20""",
    "hosp",
)
def _one_series(t):
    return tidied(aggregates.virus_series(t.hosp, "COVID-NET", min_points=20), "rate")


@query(
    "age_heatmap",
    "SELECT surveillance_network, week_ending_date, age_group, round(rate, 8) + 0.0 AS rate FROM heat",
    "hosp",
    "heat",
)
def _age_heatmap(t):
    return tidied(aggregates.age_heatmap(t.hosp), "rate")


_AGES = ["0-17", "18-64", "65+"]


@query(
    "heatmap_grid",
    """SELECT surveillance_network, week_ending_date, round("0-17", 8) + 0.0 AS "0-17",
              round("18-64", 8) + 0.0 AS "18-64", round("65+", 8) + 0.0 AS "65+" FROM (
         SELECT surveillance_network, week_ending_date, coalesce(max(CASE WHEN age_group = '0-17' THEN rate END), 0)
           AS "0-17", coalesce(max(CASE WHEN age_group = '18-64' THEN rate END), 0) AS "18-64",
           coalesce(max(CASE WHEN age_group = '65+' THEN rate END), 0) AS "65+",
           row_number() OVER (PARTITION BY surveillance_network ORDER BY week_ending_date DESC) AS back
         FROM heat GROUP BY 1, 2) WHERE back <= 26""",
    "hosp",
    "heat",
)
def _heatmap_grid(t):
    return tidied(aggregates.heatmap_grid(aggregates.age_heatmap(t.hosp), _AGES, weeks=26), *_AGES)


@query(
    "season_compare",
    """SELECT surveillance_network, season, mmwr_week, round(avg_rate, 8) + 0.0 AS avg_rate FROM season_rates""",
    "hosp",
    "season_rates",
)
def _season_compare(t):
    return tidied(aggregates.season_comparison(t.hosp), "avg_rate")


@query(
    "current_rates",
    f"""SELECT surveillance_network, {half_up("avg(weekly_rate)", 2)} AS rate FROM overall
       WHERE week_ending_date = (SELECT max(week_ending_date) FROM hosp) GROUP BY 1""",
    "hosp",
)
def _current_rates(t):
    return aggregates.current_rates(t.hosp)


@query(
    "trailing_28d",
    """SELECT surveillance_network, round(avg(weekly_rate), 8) + 0.0 AS avg_rate FROM overall
       WHERE week_ending_date >= (SELECT max(week_ending_date) - 28 FROM hosp) GROUP BY 1""",
    "hosp",
)
def _trailing_28d(t):
    return tidied(aggregates.trailing_rates(t.hosp), "avg_rate")


@query(
    "risk_share",
    """SELECT label, count(*) AS count, round(least(100, CAST(100 AS DOUBLE) * count(*) /
       greatest((SELECT count(DISTINCT geography) FROM ari), 1)), 8) + 0.0 AS share FROM ari_latest GROUP BY 1""",
    "ari",
)
def _risk_share(t):
    return aggregates.risk_share(t.ari)


@query(
    "detection_avg",
    """SELECT round(avg(coalesce(nullif(detect_prop_15d, 100), 0)), 8) + 0.0 AS avg_detection FROM ww_latest""",
    "ww",
)
def _detection_avg(t):
    # Readings of exactly 100 are taken as missing here, so that the default is met.
    sites = snapshot.wastewater_latest(t.ww)
    missing = sites.withColumn("detection_rate", F.nullif("detection_rate", F.lit(100.0)))
    return tidied(aggregates.detection_average(missing), "avg_detection")


@query(
    "series_lists",
    """SELECT virus, count(*) AS n, string_agg(strftime(date, '%Y-%m-%d') || '=' || printf('%.6f', rate), ';'
       ORDER BY date) AS points FROM series GROUP BY 1""",
    "hosp",
)
def _series_lists(t):
    lists = aggregates.series_lists(weekly_series(t), "virus", "date", "rate")
    point = lambda p: F.concat(
        F.date_format(p["date"], "yyyy-MM-dd"), F.lit("="), F.format_string("%.6f", p["rate"])
    )
    return lists.select(
        "virus", F.size("points").cast("long").alias("n"), F.concat_ws(";", F.transform("points", point)).alias("points")
    )


@query(
    "season_lists",
    """SELECT surveillance_network, season, count(*) AS n, string_agg(mmwr_week || '=' || printf('%.6f', avg_rate), ';'
       ORDER BY mmwr_week) AS points FROM season_rates GROUP BY 1, 2""",
    "hosp",
    "season_rates",
)
def _season_lists(t):
    keys = ["surveillance_network", "season"]
    lists = aggregates.series_lists(aggregates.season_comparison(t.hosp), keys, "mmwr_week", "avg_rate")
    point = lambda p: F.concat(
        p["mmwr_week"].cast("string"), F.lit("="), F.format_string("%.6f", p["avg_rate"])
    )
    return lists.select(
        *keys, F.size("points").cast("long").alias("n"), F.concat_ws(";", F.transform("points", point)).alias("points")
    )


@query(
    "state_stats",
    """SELECT geography, count(*) AS weeks, count(*) FILTER (coalesce(level, 1) >= 4) AS high_weeks,
       round(avg(coalesce(level, 1)), 8) + 0.0 AS avg_level FROM (
         SELECT *, row_number() OVER (PARTITION BY geography ORDER BY week_end DESC) AS back FROM ari)
       WHERE back <= 52 GROUP BY 1""",
    "ari",
)
def _state_stats(t):
    return tidied(aggregates.state_stats(t.ari), "avg_level")


@query("load_stats", "SELECT count(*) AS row_count, count(DISTINCT county_fips) AS counties FROM ww", "ww")
def _load_stats(t):
    return tables.load_stats(t.ww, {"counties": "county_fips"})


@query(
    "series_stats",
    """SELECT virus, round(avg(rate), 8) + 0.0 AS mean, round(stddev_pop(rate) + 1e-8, 8) + 0.0 AS std,
       count(*) AS points FROM series GROUP BY 1""",
    "hosp",
)
def _series_stats(t):
    return tidied(aggregates.series_stats(weekly_series(t)), "mean", "std")
