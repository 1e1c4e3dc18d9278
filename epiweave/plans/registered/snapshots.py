"""Filters, latest snapshots, value lists and top-k reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.operators import aggregates, snapshot
from epiweave.plans.registry import query, tidied
from epiweave.sources import landing, tables


@query(
    "hosp_trends",
    """SELECT virus, date AS week_ending_date, round(rate, 8) + 0.0 AS avg_rate FROM series""",
    "hosp",
)
def _hosp_trends(t):
    return tidied(aggregates.weekly_trends(t.hosp), "avg_rate")


@query("risk_distribution", "SELECT label, count(*) AS count FROM ari_latest GROUP BY 1", "ari")
def _risk_distribution(t):
    return aggregates.risk_distribution(t.ari)


@query("ari_latest", "SELECT week_end, geography, label, buildnumber FROM ari_latest", "ari")
def _ari_latest(t):
    return snapshot.ari_activity(t.ari)


@query(
    "ari_week",
    """SELECT week_end, geography, label, buildnumber FROM ari
       WHERE week_end = DATE '2000-06-10' AND geography = 'NATION_3'""",
    "ari",
)
def _ari_week(t):
    return snapshot.ari_activity(t.ari, week_end="2000-06-10", geography="NATION_3")


@query(
    "ari_history",
    """SELECT * FROM (SELECT week_end, geography, label,
         CAST(row_number() OVER (PARTITION BY geography ORDER BY week_end DESC) AS INTEGER) AS weeks_back FROM ari)
       WHERE weeks_back <= 52""",
    "ari",
)
def _ari_history(t):
    return snapshot.ari_history(t.ari)


HOSP_COLUMNS = (
    "surveillance_network, season, week_ending_date, mmwr_year, mmwr_week, age_group, site, weekly_rate, "
    "cumulative_rate"
)


@query(
    "hosp_recent",
    f"""SELECT {HOSP_COLUMNS} FROM overall
        ORDER BY week_ending_date DESC, surveillance_network, site, age_group LIMIT 200""",
    "hosp",
)
def _hosp_recent(t):
    return snapshot.hospitalizations(t.hosp)


@query(
    "hosp_filtered",
    f"""SELECT {HOSP_COLUMNS} FROM hosp WHERE rate_type = 'Observed' AND age_group = '65+'
          AND surveillance_network = 'RSV-NET' AND site = 'ASIA'
        ORDER BY week_ending_date DESC, surveillance_network, site, age_group LIMIT 200""",
    "hosp",
)
def _hosp_filtered(t):
    return snapshot.hospitalizations(t.hosp, network="RSV-NET", site="ASIA", age_group="65+")


@query(
    "first_50",
    f"""SELECT {HOSP_COLUMNS} FROM overall
        ORDER BY week_ending_date DESC, surveillance_network, site, age_group LIMIT 50""",
    "hosp",
)
def _first_50(t):
    return snapshot.hospitalizations(t.hosp).limit(50)


@query("columns", f"SELECT {HOSP_COLUMNS} FROM hosp", "hosp")
def _columns(t):
    return t.hosp.select(*(c.strip() for c in HOSP_COLUMNS.split(",")))


@query(
    "positivity_latest",
    "SELECT pathogen, round(percent_test_positivity, 8) + 0.0 AS percent_test_positivity, week_end FROM pos_latest",
    "pos",
)
def _positivity_latest(t):
    return tidied(snapshot.positivity_latest(t.pos), "percent_test_positivity")


@query(
    "positivity_recent",
    """SELECT week_end, pathogen, round(percent_test_positivity, 8) + 0.0 AS percent_test_positivity FROM pos
       ORDER BY week_end DESC, pathogen LIMIT 200""",
    "pos",
)
def _positivity_recent(t):
    return tidied(snapshot.positivity(t.pos), "percent_test_positivity")


@query(
    "positivity_record",
    """SELECT round(coalesce(max(CASE WHEN pathogen = 'COVID-19' THEN percent_test_positivity END), 0), 8) + 0.0 AS covid,
              round(coalesce(max(CASE WHEN pathogen = 'Influenza' THEN percent_test_positivity END), 0), 8) + 0.0 AS flu,
              round(coalesce(max(CASE WHEN pathogen = 'RSV' THEN percent_test_positivity END), 0), 8) + 0.0 AS rsv
       FROM pos_latest""",
    "pos",
)
def _positivity_record(t):
    return tidied(aggregates.positivity_record(t.pos), "covid", "flu", "rsv")


@query(
    "dominant_pathogen",
    """SELECT pathogen, round(percent_test_positivity, 8) + 0.0 AS percent_test_positivity FROM pos_latest
       ORDER BY pos_latest.percent_test_positivity DESC, pathogen LIMIT 1""",
    "pos",
)
def _dominant_pathogen(t):
    return tidied(aggregates.dominant_pathogen(t.pos), "percent_test_positivity")


_WW_COLUMNS = (
    "wwtp_jurisdiction, wwtp_id, county_names, county_fips, population_served, date_end, ptc_15d, "
    "round(detect_prop_15d, 8) + 0.0 AS detect_prop_15d, percentile"
)


@query(
    "ww_recent_rows",
    f"SELECT {_WW_COLUMNS} FROM ww ORDER BY date_end DESC, wwtp_id LIMIT 5000",
    "ww",
)
def _ww_recent_rows(t):
    return tidied(snapshot.wastewater(t.ww), "detect_prop_15d")


@query(
    "ww_filter",
    f"""SELECT {_WW_COLUMNS} FROM ww WHERE wwtp_jurisdiction = 'NATION_7' AND county_names LIKE '%ty_1%'
        ORDER BY date_end DESC, wwtp_id LIMIT 5000""",
    "ww",
)
def _ww_filter(t):
    return tidied(snapshot.wastewater(t.ww, state="NATION_7", county="ty_1"), "detect_prop_15d")


_SITE_COLUMNS = """wwtp_jurisdiction AS state, county_names AS county, county_fips AS fips, wwtp_id,
  population_served, percentile, ptc_15d AS pct_change, round(detect_prop_15d, 8) + 0.0 AS detection_rate, date_end"""


@query("ww_latest", f"SELECT {_SITE_COLUMNS} FROM ww_latest", "ww")
def _ww_latest(t):
    return tidied(snapshot.wastewater_latest(t.ww), "detection_rate")


@query("ww_top20", f"SELECT {_SITE_COLUMNS} FROM ww_latest ORDER BY percentile DESC, wwtp_id LIMIT 20", "ww")
def _ww_top20(t):
    return tidied(snapshot.by_percentile(snapshot.wastewater_latest(t.ww), limit=20), "detection_rate")


@query("ww_state_sites", f"SELECT {_SITE_COLUMNS} FROM ww_latest WHERE wwtp_jurisdiction = 'NATION_12'", "ww")
def _ww_state_sites(t):
    return tidied(snapshot.by_percentile(snapshot.wastewater_latest(t.ww), state="NATION_12"), "detection_rate")


@query("high_signal", f"SELECT {_SITE_COLUMNS} FROM ww_latest WHERE percentile >= 80", "ww")
def _high_signal(t):
    return tidied(snapshot.high_signal(snapshot.wastewater_latest(t.ww)), "detection_rate")


@query(
    "ww_county",
    """SELECT date_end, percentile, ptc_15d, round(detect_prop_15d, 8) + 0.0 AS detect_prop_15d, population_served,
              county_names, wwtp_jurisdiction FROM ww WHERE county_fips = '00007'""",
    "ww",
)
def _ww_county(t):
    return tidied(snapshot.wastewater_county(t.ww, "00007"), "detect_prop_15d")


@query(
    "ww_recent",
    "SELECT wwtp_id, date_end, percentile FROM ww WHERE date_end > CAST(DATE '2001-09-30' - INTERVAL 90 DAY AS DATE)",
    "ww",
)
def _ww_recent(t):
    return landing.recent_only(t.ww, "2001-09-30", 90).select("wwtp_id", "date_end", "percentile")


@query("states", "SELECT DISTINCT geography FROM ari", "ari")
def _states(t):
    return snapshot.distinct_values(t.ari, "geography")


@query("sites", "SELECT DISTINCT site FROM hosp", "hosp")
def _sites(t):
    return snapshot.distinct_values(t.hosp, "site")


@query("seasons", "SELECT DISTINCT surveillance_network, season FROM hosp", "hosp")
def _seasons(t):
    return snapshot.distinct_values(t.hosp, "surveillance_network", "season")


@query("age_groups", "SELECT DISTINCT age_group FROM hosp", "hosp")
def _age_groups(t):
    return snapshot.distinct_values(t.hosp, "age_group")


@query("weeks", "SELECT DISTINCT week_ending_date FROM hosp", "hosp")
def _weeks(t):
    return snapshot.distinct_values(t.hosp, "week_ending_date")


@query(
    "iso_dates",
    """SELECT wwtp_id, strftime(date_start, '%Y-%m-%d') AS date_start, strftime(date_end, '%Y-%m-%d') AS date_end,
              strftime(first_sample_date, '%Y-%m-%d') AS first_sample_date FROM ww""",
    "ww",
)
def _iso_dates(t):
    return snapshot.iso_dates(t.ww).select("wwtp_id", "date_start", "date_end", "first_sample_date")


@query(
    "param_query",
    """SELECT label, count(*) AS n FROM ari WHERE geography = 'NATION_4' AND week_end >= DATE '2000-01-01'
       GROUP BY label""",
    "ari",
)
def _param_query(t):
    return tables.run_query(
        t.spark,
        "SELECT label, count(*) AS n FROM {ari_activity} WHERE geography = ? AND week_end >= CAST(? AS DATE) "
        "GROUP BY label",
        ["NATION_4", "2000-01-01"],
        ari_activity=t.ari,
    )


@query(
    "high_labels",
    "SELECT week_end, geography, label, buildnumber FROM ari WHERE label IN ('High', 'Very High')",
    "ari",
)
def _high_labels(t):
    return aggregates.high_label_rows(t.ari)


@query("high_risk", "SELECT geography, label FROM ari_latest WHERE label IN ('High', 'Very High')", "ari")
def _high_risk(t):
    return snapshot.high_risk(t.ari).select("geography", "label")


@query(
    "current_label",
    """SELECT asked.geography, coalesce(label, 'Unknown') AS label, week_end
       FROM (SELECT n_name AS geography FROM nation UNION ALL SELECT r_name FROM region) asked
       LEFT JOIN ari_latest ON asked.geography = ari_latest.geography""",
    "ari",
)
def _current_label(t):
    asked = t.table("nation").select(F.col("n_name").alias("geography"))
    unknown = t.table("region").select(F.col("r_name").alias("geography"))
    return snapshot.current_label(t.ari, asked.unionByName(unknown))
