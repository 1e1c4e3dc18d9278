"""Registration of queries: a Spark plan next to the SQL that must agree with it.

Every query reads whole test tables through ``sources.testdata``. The SQL is
written for DuckDB over the same Parquet files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from epiweave.functions import scalars as S
from epiweave.operators import aggregates
from epiweave.session import shared_dir
from epiweave.sources import testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# --- The derived tables, as SQL ----------------------------------------------

def half_up(expression: str, places: int) -> str:
    """Half-up rounding of a value first rounded to 8 places, as in ``scalars.round_to``."""
    return f"CAST(round(CAST(round({expression}, 8) AS DECIMAL(28, 8)), {places}) AS DOUBLE) + 0.0"


CTES = {
    "hosp": """
hosp_weekly AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'COVID-NET' WHEN 'N' THEN 'FluSurv-NET' WHEN 'R' THEN 'RSV-NET' END
           AS surveillance_network,
         CAST(date_trunc('week', l_shipdate) AS DATE) + 5 AS week_ending_date,
         CASE l_linenumber % 4 WHEN 0 THEN '0-17' WHEN 1 THEN '18-64' WHEN 2 THEN '65+' WHEN 3 THEN 'Overall' END
           AS age_group,
         r_name AS site,
         CASE WHEN l_linestatus = 'F' THEN 'Observed' ELSE 'Estimated' END AS rate_type,
         sum(l_quantity) AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
), hosp_seasons AS (
  SELECT *, CAST(year(week_ending_date) - CASE WHEN month(week_ending_date) < 7 THEN 1 ELSE 0 END AS INTEGER) AS y
  FROM hosp_weekly
), hosp AS (
  SELECT surveillance_network, y || '-' || (y + 1) AS season, week_ending_date,
         CAST(year(week_ending_date) AS INTEGER) AS mmwr_year,
         CAST(weekofyear(week_ending_date) AS INTEGER) AS mmwr_week,
         age_group, 'Overall' AS sex, 'Overall' AS race_ethnicity, site,
         quantity / CAST(10 AS DOUBLE) AS weekly_rate,
         sum(quantity) OVER (PARTITION BY surveillance_network, y, age_group, site, rate_type
                             ORDER BY week_ending_date) / CAST(10 AS DOUBLE) AS cumulative_rate,
         rate_type
  FROM hosp_seasons
), overall AS (
  SELECT * FROM hosp WHERE age_group = 'Overall' AND sex = 'Overall' AND race_ethnicity = 'Overall'
    AND rate_type = 'Observed'
), series AS (
  SELECT surveillance_network AS virus, week_ending_date AS date, avg(weekly_rate) AS rate
  FROM overall GROUP BY 1, 2
), indexed AS (
  SELECT *, row_number() OVER (PARTITION BY virus ORDER BY date) - 1 AS idx,
         count(*) OVER (PARTITION BY virus) AS points FROM series
)""",
    "ari": """
ari_keys AS (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 5 AS week_end, n_name AS geography,
         max(o_orderkey) % 7 AS k
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
), ari AS (
  SELECT week_end, geography,
         CASE k WHEN 0 THEN 'Minimal' WHEN 1 THEN 'Very Low' WHEN 2 THEN 'Low' WHEN 3 THEN 'Moderate'
                WHEN 4 THEN 'High' WHEN 5 THEN 'Very High' ELSE 'Data Unavailable' END AS label,
         CAST(k AS VARCHAR) AS buildnumber,
         CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 END AS level
  FROM ari_keys
), ari_latest AS (SELECT * FROM ari WHERE week_end = (SELECT max(week_end) FROM ari))""",
    "places": """
places AS (
  SELECT week_end, geography, label, level FROM ari UNION ALL
  SELECT week_end, geography, label, CASE label WHEN 'Minimal' THEN 0 WHEN 'Very Low' THEN 1 WHEN 'Low' THEN 2
           WHEN 'Moderate' THEN 3 WHEN 'High' THEN 4 WHEN 'Very High' THEN 5 END AS level
  FROM (SELECT week_end, r_name AS geography, max(label) AS label FROM ari JOIN nation ON geography = n_name
        JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
), places_latest AS (SELECT * FROM places WHERE week_end = (SELECT max(week_end) FROM places))""",
    "pos": """
pos AS (
  SELECT CAST(ts AS DATE) AS week_end,
         CASE event_type WHEN 'click' THEN 'COVID-19' WHEN 'view' THEN 'Influenza' WHEN 'purchase' THEN 'RSV'
                         ELSE event_type END AS pathogen,
         CAST(100 AS DOUBLE) * count(*) FILTER (value > 50) / count(*) AS percent_test_positivity
  FROM events GROUP BY 1, 2
), pos_latest AS (SELECT * FROM pos WHERE week_end = (SELECT max(week_end) FROM pos))""",
    "ww": """
ww_months AS (
  SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date_start, sum(l_quantity) AS quantity,
         count(*) FILTER (l_discount > CAST(0.02 AS DOUBLE)) AS detected, count(*) AS samples
  FROM lineitem GROUP BY 1, 2
), ww AS (
  SELECT n_name AS wwtp_jurisdiction, CAST(l_suppkey AS VARCHAR) AS wwtp_id,
         'County_' || (l_suppkey % 20) AS county_names,
         lpad(CAST(l_suppkey % 20 AS VARCHAR), 5, '0') AS county_fips,
         CAST(1000 * (l_suppkey + 1) AS INTEGER) AS population_served, date_start,
         last_day(date_start) AS date_end, quantity - CAST(200 AS DOUBLE) AS ptc_15d,
         CAST(100 AS DOUBLE) * detected / samples AS detect_prop_15d,
         CAST(CAST(quantity AS BIGINT) % 101 AS DOUBLE) AS percentile, 'no' AS sampling_prior,
         min(date_start) OVER (PARTITION BY l_suppkey) AS first_sample_date
  FROM ww_months JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), ww_latest AS (SELECT * FROM ww WHERE date_end = (SELECT max(date_end) FROM ww))""",
    "states": """
states AS (
  SELECT n_name AS geography, 'N' || n_nationkey AS code, CAST(n_nationkey + 25 AS DOUBLE) AS lat,
         CAST(n_nationkey * 2 - 120 AS DOUBLE) AS lng
  FROM nation
)""",
    "questions": """
questions AS (
  SELECT c_custkey AS question_id,
         CASE c_custkey % 5 WHEN 0 THEN 'What is happening in ' || n_name || '?'
              WHEN 1 THEN 'Current FLU positivity' WHEN 2 THEN 'Which places are the worst'
              WHEN 3 THEN 'Show me a summary' ELSE 'Any outbreak near ' || lower(n_name) || ' today' END AS question
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)""",
    "season_rates": """
season_rates AS (
  SELECT surveillance_network, season, mmwr_week, avg(weekly_rate) AS avg_rate FROM overall GROUP BY 1, 2, 3
)""",
    "heat": """
heat AS (
  SELECT surveillance_network, week_ending_date, age_group, avg(weekly_rate) AS rate FROM hosp
  WHERE rate_type = 'Observed' AND age_group <> 'Overall' GROUP BY 1, 2, 3
)""",
    "wow": """
wow AS (
  SELECT virus, date, rate, coalesce(lag(rate) OVER (PARTITION BY virus ORDER BY date), 0) AS previous,
         row_number() OVER (PARTITION BY virus ORDER BY date DESC) AS back FROM series
)""",
    "samples": """
samples AS (
  SELECT virus, date, idx, lag(rate, 1) OVER s AS lag_1, lag(rate, 2) OVER s AS lag_2, lag(rate, 4) OVER s AS lag_4,
         lag(rate, 8) OVER s AS lag_8, avg(rate) OVER (s ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS roll_avg_4,
         avg(rate) OVER (s ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS roll_avg_8,
         stddev_pop(rate) OVER (s ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS roll_std_4, rate AS target, points
  FROM indexed WINDOW s AS (PARTITION BY virus ORDER BY date)
), tabular AS (
  SELECT *, lag_1 - lag_2 AS diff_1, sin(2 * pi() * idx / 52) AS week_sin, cos(2 * pi() * idx / 52) AS week_cos
  FROM samples WHERE points >= 12 AND idx >= 8 AND idx < points - 1
)""",
    "norm": """
norm AS (
  SELECT i.*, m.mean, m.std, (rate - mean) / std AS norm FROM indexed i JOIN (
    SELECT virus, avg(rate) AS mean, stddev_pop(rate) + CAST(1e-8 AS DOUBLE) AS std FROM series GROUP BY 1) m
  ON i.virus = m.virus
)""",
}

# Samples, normal equations (elim: one more column eliminated per k) and coefficients of the model per series.
CTES["panel"] = """
terms AS (
  SELECT *, list(norm) OVER (v ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS past,
         list(norm) OVER (v ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS y
  FROM norm WHERE points >= 30 WINDOW v AS (PARTITION BY virus ORDER BY date)
), panel_samples AS (
  SELECT virus, date, std, y, list_concat([CAST(1 AS DOUBLE)], past, [sin(2 * pi() * idx / 52), cos(2 * pi() * idx / 52)]) AS x,
         row_number() OVER (PARTITION BY virus ORDER BY date)
           <= floor(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY virus)) AS is_train
  FROM terms WHERE idx >= 12 AND idx < points - 4
), entries AS (
  SELECT virus, i, j, sum(x[i] * list_concat(x, y)[j])
           + CASE WHEN i = j AND i > 1 THEN count(*) * CAST(0.001 AS DOUBLE) ELSE 0 END AS v
  FROM panel_samples, range(1, 16) AS a(i), range(1, 20) AS b(j) WHERE is_train GROUP BY 1, 2, 3
), start AS (
  SELECT virus, list(cells ORDER BY i) AS m FROM (
    SELECT virus, i, list(v ORDER BY j) AS cells FROM entries GROUP BY 1, 2) GROUP BY 1
), elim AS (
  SELECT virus, 1 AS k, m FROM start UNION ALL
  SELECT virus, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
    ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END) FROM elim WHERE k <= 15
), coefficients AS (
  SELECT virus, h, list(m[i][15 + h] ORDER BY i) AS c
  FROM elim, range(1, 16) AS a(i), range(1, 5) AS b(h) WHERE k = 16 GROUP BY 1, 2
), panel_quality AS (
  SELECT s.virus, avg(abs(list_dot_product(x, c) - y[h])) FILTER (NOT is_train) * any_value(std) AS mae,
         count(*) FILTER (is_train) // 4 AS train_samples, count(*) FILTER (NOT is_train) // 4 AS val_samples
  FROM panel_samples s JOIN coefficients c ON s.virus = c.virus GROUP BY 1
)"""

CTES["streamed"] = """
pos AS (
  SELECT CAST(ts AS DATE) AS week_end, CASE event_type WHEN 'click' THEN 'COVID-19' WHEN 'view' THEN 'Influenza'
         WHEN 'purchase' THEN 'RSV' ELSE event_type END AS pathogen, arg_max(value, event_id) AS percent_test_positivity
  FROM events GROUP BY 1, 2
), pos_latest AS (SELECT * FROM pos WHERE week_end = (SELECT max(week_end) FROM pos))"""

_SCENARIO_FIELDS = """
  CAST(10 AS DOUBLE) AS hospitalization_pct, CAST(20 AS DOUBLE) AS icu_pct, CAST(5 AS DOUBLE) AS avg_los_days,
  CAST(10 AS DOUBLE) AS icu_los_days, CAST(3000 AS DOUBLE) AS cost_per_bed_day,
  CAST(8000 AS DOUBLE) AS cost_per_icu_day, 8 AS weeks"""
CTES["scenarios"] = f"""
scenarios AS (
  SELECT p_partkey AS scenario_id, CAST(100000 * (p_size + 1) AS BIGINT) AS population,
         p_size / CAST(2 AS DOUBLE) AS current_rate, 1 + (p_partkey % 5) / CAST(2 AS DOUBLE) AS surge_multiplier,
         CAST(10 * p_size AS BIGINT) AS beds_available, CAST(p_size AS BIGINT) AS icu_beds_available,
         {_SCENARIO_FIELDS} FROM part
)"""
CTES["hospitals"] = f"""
hospitals AS (
  SELECT s_suppkey AS scenario_id, CAST(100000 * (s_suppkey % 40 + 1) AS BIGINT) AS population,
         (s_suppkey % 30 + 1) / CAST(2 AS DOUBLE) AS current_rate,
         1 + (s_suppkey % 5) / CAST(2 AS DOUBLE) AS surge_multiplier,
         CAST(10 * (s_suppkey % 40 + 1) AS BIGINT) AS beds_available,
         CAST(s_suppkey % 40 + 1 AS BIGINT) AS icu_beds_available,
         {_SCENARIO_FIELDS} FROM supplier
)"""


def _sql(body: str, *ctes: str) -> str:
    recursive = "RECURSIVE " if "panel" in ctes else ""
    return (f"WITH {recursive}{','.join(CTES[c] for c in ctes)}\n" if ctes else "") + body


def query(name: str, body: str | None = None, *ctes: str) -> Callable[[Callable], Callable]:
    """Register a query; ``body`` is its SQL on top of the named derived tables."""

    def register(build: Callable[[SimpleNamespace], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: build(sources_of(spark, folder))
        if body is not None:
            ORACLE[name] = _sql(body, *ctes)
        return build

    return register


class Sources(SimpleNamespace):
    """Lazily derived tables of one data folder, by attribute."""

    def __getattr__(self, name: str) -> DataFrame:
        return getattr(testdata, name)(self.spark, self.folder)

    def table(self, name: str) -> DataFrame:
        return testdata.table(self.spark, self.folder, name)


def sources_of(spark: SparkSession, folder: str) -> Sources:
    return Sources(spark=spark, folder=folder.rstrip("/"))


def tidied(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: S.tidy(c) for c in columns})


def weekly_series(t: Sources) -> DataFrame:
    return aggregates.virus_series(t.hosp)


def work_folder(t: Sources, purpose: str) -> str:
    """A new folder on the shared storage for tables a query writes."""
    return f"{shared_dir(t.spark)}/epiweave/{t.spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex[:12]}"
