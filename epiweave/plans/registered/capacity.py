"""Capacity scenarios: expected demand, its cost and peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.functions import scalars as S
from epiweave.operators import aggregates
from epiweave.operators import scenarios as capacity
from epiweave.plans.registry import half_up, query, tidied

_EXPECTED = """
  CAST(week AS INTEGER) AS week, round(1 + (surge_multiplier - 1) * least(1, week / CAST(4 AS DOUBLE)), 8) + 0.0
    AS week_multiplier, round(adm, 8) + 0.0 AS admissions, round(adm * icu_pct / 100, 8) + 0.0 AS icu_admissions,
  round(adm * least(avg_los_days / 7, CAST(1.5 AS DOUBLE)), 8) + 0.0 AS beds,
  round(adm * icu_pct / 100 * least(icu_los_days / 7, CAST(2 AS DOUBLE)), 8) + 0.0 AS icu_beds,
  round(round(adm * least(avg_los_days / 7, CAST(1.5 AS DOUBLE)) * cost_per_bed_day * 7 + adm * icu_pct / 100 *
    least(icu_los_days / 7, CAST(2 AS DOUBLE)) * cost_per_icu_day * 7, 6), 4) + 0.0 AS cost"""
_ADMISSIONS = """current_rate * (1 + (surge_multiplier - 1) * least(1, week / CAST(4 AS DOUBLE))) *
  (population / CAST(100000 AS DOUBLE)) * (hospitalization_pct / 100) AS adm"""
_EXPECTED_COLUMNS = ["week", "week_multiplier", "admissions", "icu_admissions", "beds", "icu_beds", "cost"]


def _expected(df: DataFrame, *keys: str) -> DataFrame:
    rounded = tidied(df, *_EXPECTED_COLUMNS[1:-1])
    return rounded.withColumn("cost", F.round(F.round("cost", 6), 4) + F.lit(0.0)).select(*keys, *_EXPECTED_COLUMNS)


@query(
    "scenario_expected",
    f"SELECT scenario_id, {_EXPECTED} FROM (SELECT *, {_ADMISSIONS} FROM scenarios, range(8) AS w(week))",
    "scenarios",
)
def _scenario_expected(t):
    return _expected(capacity.expected_demand(t.scenarios), "scenario_id")


@query(
    "scenario_weeks",
    """SELECT scenario_id, CAST(week AS INTEGER) AS week FROM scenarios, range(8) AS w(week)
       WHERE week < CASE scenario_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 8 END""",
    "scenarios",
)
def _scenario_weeks(t):
    # Scenarios over no, one and eight weeks.
    given = t.scenarios.withColumn("weeks", F.expr("CASE scenario_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 8 END"))
    return capacity.expected_demand(given).select("scenario_id", "week")


@query(
    "scenario_seeded",
    f"""SELECT scenario_id, surveillance_network, {_EXPECTED} FROM (SELECT *, {_ADMISSIONS} FROM (
          SELECT s.* EXCLUDE (current_rate), surveillance_network, r.rate AS current_rate FROM scenarios s,
            (SELECT surveillance_network, {half_up("avg(weekly_rate)", 2)} AS rate FROM overall
             WHERE week_ending_date = (SELECT max(week_ending_date) FROM hosp) GROUP BY 1) r), range(8) AS w(week))""",
    "scenarios",
    "hosp",
)
def _scenario_seeded(t):
    seeded = capacity.seeded(capacity.with_defaults(t.scenarios), aggregates.current_rates(t.hosp))
    return _expected(capacity.expected_demand(seeded, "surveillance_network"), "scenario_id", "surveillance_network")


@query(
    "scenario_defaults",
    """SELECT p_partkey AS scenario_id, CAST(CASE WHEN p_size = 1 THEN 1000000 ELSE 100000 * (p_size + 1) END AS BIGINT)
         AS population, p_size / CAST(2 AS DOUBLE) AS current_rate, CAST(2 AS DOUBLE) AS surge_multiplier,
         CAST(10 AS DOUBLE) AS hospitalization_pct, CAST(20 AS DOUBLE) AS icu_pct, CAST(5 AS DOUBLE) AS avg_los_days,
         CAST(10 AS DOUBLE) AS icu_los_days, CAST(10 * p_size AS BIGINT) AS beds_available,
         CAST(p_size AS BIGINT) AS icu_beds_available, CAST(3000 AS DOUBLE) AS cost_per_bed_day,
         CAST(8000 AS DOUBLE) AS cost_per_icu_day, CAST(8 AS BIGINT) AS weeks FROM part""",
)
def _scenario_defaults(t):
    # One column is left out and one population blanked, so that both defaults are met.
    given = t.scenarios.drop("surge_multiplier")
    return capacity.with_defaults(given.withColumn("population", F.nullif("population", F.lit(200000))))


@query(
    "scenario_cost",
    f"""SELECT scenario_id, {half_up("sum(cost)", 0)} AS total_cost FROM (
          SELECT scenario_id, {_EXPECTED} FROM (SELECT *, {_ADMISSIONS} FROM hospitals, range(8) AS w(week)))
        GROUP BY 1""",
    "hospitals",
)
def _scenario_cost(t):
    return capacity.total_cost(capacity.expected_demand(t.hospitals))


@query(
    "scenario_cost_text",
    f"""SELECT scenario_id, CASE WHEN c >= 1e9 THEN printf('$%.1fB', {half_up("c / 1e9", 1)})
         WHEN c >= 1e6 THEN printf('$%.1fM', {half_up("c / 1e6", 1)})
         WHEN c >= 1e3 THEN printf('$%.0fK', {half_up("c / 1e3", 0)}) ELSE printf('$%.0f', round(c, 0)) END AS cost
       FROM (SELECT scenario_id, CAST(population AS DOUBLE) * current_rate AS c FROM scenarios)""",
    "scenarios",
)
def _scenario_cost_text(t):
    amount = F.col("population").cast("double") * F.col("current_rate")
    return t.scenarios.select("scenario_id", S.currency_text(amount).alias("cost"))


@query(
    "scenario_peaks",
    f"""SELECT scenario_id, peak_beds, peak_icu_beds, weeks_over_pct, peak_beds > beds_available AS beds_exceeded,
       peak_icu_beds > icu_beds_available AS icu_exceeded, CASE WHEN weeks_over_pct > 50 THEN 'high'
       WHEN weeks_over_pct > 20 THEN 'moderate' ELSE 'safe' END AS overflow_band
       FROM (SELECT scenario_id, {half_up("max(beds)", 1)} AS peak_beds, {half_up("max(icu_beds)", 1)} AS peak_icu_beds,
                    {half_up("avg(CASE WHEN beds > beds_available THEN 1 ELSE 0 END) * 100", 1)} AS weeks_over_pct
             FROM (SELECT scenario_id, beds_available, {_EXPECTED}
                   FROM (SELECT *, {_ADMISSIONS} FROM hospitals, range(8) AS w(week))) GROUP BY 1)
       JOIN hospitals USING (scenario_id)""",
    "hospitals",
)
def _scenario_peaks(t):
    return capacity.peaks(capacity.expected_demand(t.hospitals))
