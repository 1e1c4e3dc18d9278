"""Week-over-week, seasons, anomalies and gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.functions import scalars as S
from epiweave.operators import aggregates, anomalies, trends
from epiweave.plans.registry import half_up, query, tidied, weekly_series, work_folder
from epiweave.sources import tables

_WOW_COLUMNS = f"""virus, date, round(rate, 8) + 0.0 AS rate, round(previous, 8) + 0.0 AS previous,
  CASE WHEN previous > 0 THEN {half_up("(rate - previous) / previous * 100", 1)} ELSE 0 END AS change_pct"""


@query("wow_change", f"SELECT {_WOW_COLUMNS} FROM wow WHERE back = 1", "hosp", "wow")
def _wow_change(t):
    return tidied(trends.week_over_week(weekly_series(t)), "rate", "previous")


@query("wow_history", f"SELECT {_WOW_COLUMNS} FROM wow", "hosp", "wow")
def _wow_history(t):
    return tidied(trends.week_over_week(weekly_series(t), latest_only=False), "rate", "previous")


@query(
    "last_two_seasons",
    """SELECT surveillance_network, season, mmwr_week, round(avg_rate, 8) + 0.0 AS avg_rate, season_rank FROM (
         SELECT *, CAST(dense_rank() OVER (PARTITION BY surveillance_network ORDER BY season DESC) AS INTEGER)
           AS season_rank FROM season_rates) WHERE season_rank <= 2""",
    "hosp",
    "season_rates",
)
def _last_two_seasons(t):
    return tidied(trends.last_seasons(aggregates.season_comparison(t.hosp)), "avg_rate")


@query(
    "season_alignment",
    """SELECT surveillance_network, season, mmwr_week, round(avg_rate, 8) + 0.0 AS avg_rate,
       lag(season) OVER w AS previous_season, round(lag(avg_rate) OVER w, 8) + 0.0 AS previous_rate
       FROM season_rates WINDOW w AS (PARTITION BY surveillance_network, mmwr_week ORDER BY season)""",
    "hosp",
    "season_rates",
)
def _season_alignment(t):
    return tidied(trends.season_alignment(aggregates.season_comparison(t.hosp)), "avg_rate", "previous_rate")


def _anomaly_sql(z_min: float, recent: str) -> str:
    return f"""
SELECT detected_date, geography, metric, {half_up("latest", 2)} AS value,
       {half_up("z", 2)} AS z_score, CASE WHEN abs(z) > 3 THEN 'Critical' ELSE 'Warning' END AS severity,
       printf('%s %s rate is %.1fσ %s average (%.1f vs avg %.1f)', geography, replace(metric, '-NET', ''),
              {half_up("abs(z)", 1)}, CASE WHEN z > 0 THEN 'above' ELSE 'below' END, {half_up("latest", 1)},
              {half_up("mean", 1)}) AS description
FROM (SELECT *, (latest - mean) / (std + 1e-8) AS z FROM (
  SELECT site AS geography, surveillance_network AS metric, count(*) AS points,
         max(week_ending_date) FILTER (back = 1) AS detected_date, max(weekly_rate) FILTER (back = 1) AS latest,
         avg(weekly_rate) FILTER (back > 1) AS mean, stddev_pop(weekly_rate) FILTER (back > 1) AS std
  FROM (SELECT *, row_number() OVER (PARTITION BY site, surveillance_network ORDER BY week_ending_date DESC) AS back
        FROM {recent}) GROUP BY 1, 2) WHERE points >= 8)
WHERE abs(z) > {z_min} ORDER BY abs({half_up("z", 2)}) DESC, geography, metric LIMIT 20"""


_RECENT_WEEKS = """(SELECT * FROM overall QUALIFY row_number() OVER (PARTITION BY site, surveillance_network
  ORDER BY week_ending_date DESC) <= 104)"""


@query("anomalies", _anomaly_sql(2.0, _RECENT_WEEKS), "hosp")
def _anomalies(t):
    return anomalies.detect_anomalies(t.hosp, 20)


@query("anomalies_low", _anomaly_sql(0.5, _RECENT_WEEKS), "hosp")
def _anomalies_low(t):
    return anomalies.detect_anomalies(t.hosp, 20, z_min=0.5)


@query("anomalies_by_weeks", _anomaly_sql(0.5, _RECENT_WEEKS), "hosp")
def _anomalies_by_weeks(t):
    return anomalies.detect_anomalies(t.hosp, 20, z_min=0.5, recent_weeks=104)


@query("stored_anomalies", _anomaly_sql(0.5, _RECENT_WEEKS), "hosp")
def _stored_anomalies(t):
    # Stored twice: the second run replaces the rows of the first.
    folder = work_folder(t, "anomalies")
    tables.declare_tables(t.spark, folder, ("anomalies",))
    found = anomalies.detect_anomalies(t.hosp, 20, z_min=0.5)
    for _ in range(2):
        tables.append_results(t.spark, folder, "anomalies", found)
    return tables.read_table(t.spark, folder, "anomalies")


@query(
    "missing_weeks",
    """SELECT g.virus, g.date, s.rate IS NULL AS interpolated,
       round(coalesce(s.rate, b.rate + (a.rate - b.rate) * (g.date - b.date) / (a.date - b.date)), 8) + 0.0 AS rate
       FROM (SELECT virus, CAST(unnest(generate_series(min(date), max(date), INTERVAL 7 DAY)) AS DATE) AS date
             FROM series GROUP BY virus) g
       LEFT JOIN series s ON g.virus = s.virus AND g.date = s.date
       ASOF LEFT JOIN series b ON g.virus = b.virus AND g.date >= b.date
       ASOF LEFT JOIN series a ON g.virus = a.virus AND g.date <= a.date""",
    "hosp",
)
def _missing_weeks(t):
    return tidied(trends.fill_missing_weeks(weekly_series(t)), "rate")


@query(
    "ww_rolling",
    """SELECT wwtp_id, date_end, percentile, round(avg(percentile) OVER (PARTITION BY wwtp_id ORDER BY date_end
       RANGE BETWEEN INTERVAL 89 DAYS PRECEDING AND CURRENT ROW), 8) + 0.0 AS rolling_percentile FROM ww""",
    "ww",
)
def _ww_rolling(t):
    return tidied(trends.wastewater_rolling(t.ww), "rolling_percentile")


@query(
    "ww_lead",
    """SELECT virus, CAST(k AS INTEGER) AS lead, round(corr(s, rate), 8) + 0.0 AS corr FROM (
         SELECT r.virus, r.rate, r.period, k, lag(w.signal, k) OVER (PARTITION BY virus, k ORDER BY r.period) AS s
         FROM (SELECT surveillance_network AS virus, last_day(week_ending_date) AS period, avg(weekly_rate) AS rate
               FROM overall GROUP BY 1, 2) r
         JOIN (SELECT date_end AS period, avg(percentile) AS signal FROM ww GROUP BY 1) w ON r.period = w.period,
         range(5) AS leads(k)) GROUP BY 1, 2""",
    "hosp",
    "ww",
)
def _ww_lead(t):
    signal = t.ww.groupBy(F.col("date_end").alias("period")).agg(F.avg("percentile").alias("signal"))
    rates = (
        t.hosp.filter(S.is_overall_observed())
        .groupBy(F.col("surveillance_network").alias("virus"), F.last_day("week_ending_date").alias("period"))
        .agg(F.avg("weekly_rate").alias("rate"))
    )
    return tidied(trends.lead_correlation(signal, rates), "corr")
