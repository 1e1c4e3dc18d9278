"""Supervised samples from the weekly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from epiweave.functions import scalars as S
from epiweave.operators import aggregates, features, forecasting
from epiweave.plans.registry import half_up, query, tidied, weekly_series

_TABULAR = ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in [*features.TABULAR_FEATURES, "target"])


@query("tabular_features", f"SELECT virus, date, CAST(idx AS INTEGER) AS idx, {_TABULAR} FROM tabular", "hosp", "samples")
def _tabular_features(t):
    return tidied(features.tabular_samples(weekly_series(t)), *features.TABULAR_FEATURES, "target")


@query(
    "sequence_features",
    """SELECT s.virus, s.date, CAST(step AS INTEGER) AS step, round(value, 8) + 0.0 AS value,
         round(lag1, 8) + 0.0 AS lag1, round(lag2, 8) + 0.0 AS lag2, round(roll_avg, 8) + 0.0 AS roll_avg,
         round(sin(2 * pi() * (s.idx - 12 + step) / 52), 8) + 0.0 AS week_sin,
         round(t0, 8) + 0.0 AS t0, round(t1, 8) + 0.0 AS t1, round(t2, 8) + 0.0 AS t2, round(t3, 8) + 0.0 AS t3
       FROM (
         SELECT a.virus, a.date, a.idx, a.t0, a.t1, a.t2, a.t3, b.idx - a.idx + 12 AS step, b.norm AS value,
           coalesce(lag(b.norm, 1) OVER w, b.norm) AS lag1, coalesce(lag(b.norm, 2) OVER w, b.norm) AS lag2,
           avg(b.norm) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS roll_avg
         FROM (SELECT *, norm AS t0, lead(norm, 1) OVER v AS t1, lead(norm, 2) OVER v AS t2, lead(norm, 3) OVER v AS t3
               FROM norm WINDOW v AS (PARTITION BY virus ORDER BY date)) a
         JOIN norm b ON a.virus = b.virus AND b.idx BETWEEN a.idx - 12 AND a.idx - 1
         WHERE a.points >= 16 AND a.idx >= 12 AND a.idx < a.points - 4
         WINDOW w AS (PARTITION BY a.virus, a.idx ORDER BY b.idx)) s""",
    "hosp",
    "norm",
)
def _sequence_features(t):
    samples = features.sequence_samples(features.normalised(weekly_series(t)), "norm")
    targets = [F.get(F.col("targets"), F.lit(h)).alias(f"t{h}") for h in range(features.HORIZON)]
    rows = samples.select("virus", "date", F.explode("steps").alias("s"), *targets)
    flat = rows.select("virus", "date", "s.*", *(f"t{h}" for h in range(features.HORIZON)))
    return tidied(flat, "value", "lag1", "lag2", "roll_avg", "week_sin", "t0", "t1", "t2", "t3")


@query(
    "next_week_features",
    """SELECT virus, date, points, round(r[8], 8) + 0.0 AS lag_1, round(r[7], 8) + 0.0 AS lag_2,
         round(r[5], 8) + 0.0 AS lag_4, round(r[1], 8) + 0.0 AS lag_8, round(list_avg(r[5:8]), 8) + 0.0 AS roll_avg_4,
         round(list_avg(r), 8) + 0.0 AS roll_avg_8, round(list_stddev_pop(r[5:8]), 8) + 0.0 AS roll_std_4,
         round(r[8] - r[7], 8) + 0.0 AS diff_1, round(sin(2 * pi() * points / 52), 8) + 0.0 AS week_sin,
         round(cos(2 * pi() * points / 52), 8) + 0.0 AS week_cos FROM (
           SELECT virus, max(date) AS date, any_value(points) AS points, list(rate ORDER BY date) AS r
           FROM indexed WHERE idx >= points - 8 GROUP BY 1)""",
    "hosp",
)
def _next_week_features(t):
    state = forecasting.next_week_features(forecasting.last_values(weekly_series(t))).drop("recent")
    return tidied(state, *features.TABULAR_FEATURES)


@query(
    "normalised",
    """SELECT virus, date, round(rate, 8) + 0.0 AS rate, round(mean, 8) + 0.0 AS mean, round(std, 8) + 0.0 AS std,
       round(norm, 8) + 0.0 AS norm FROM norm""",
    "hosp",
    "norm",
)
def _normalised(t):
    return tidied(features.normalised(weekly_series(t)), "rate", "mean", "std", "norm")


@query("denormalised", "SELECT virus, date, round(rate, 6) + 0.0 AS rate FROM series", "hosp")
def _denormalised(t):
    series = weekly_series(t)
    scaled = features.normalised(series).select("virus", "date", F.col("norm").alias("rate"))
    back = features.denormalise(scaled, aggregates.series_stats(series), "rate")
    return back.withColumn("rate", S.tidy("rate", 6))


@query(
    "split",
    """SELECT virus, date, row_number() OVER (PARTITION BY virus ORDER BY date) <=
       floor(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY virus)) AS is_train FROM tabular""",
    "hosp",
    "samples",
)
def _split(t):
    return features.time_split(features.tabular_samples(weekly_series(t))).select("virus", "date", "is_train")


@query(
    "recent8",
    f"""SELECT virus, date, 'Week -' || back AS label, {half_up("rate", 2)} AS rate FROM wow WHERE back <= 8""",
    "hosp",
    "wow",
)
def _recent8(t):
    return features.recent_rates(weekly_series(t))


_STATUS = ", ".join(
    f"CASE WHEN count(*) >= {n} THEN 'ok' ELSE 'insufficient_data' END AS {c}"
    for n, c in ((30, "training"), (12, "direct_forecast"), (8, "recursive_forecast"))
)


@query("series_status", f"SELECT virus, count(*) AS points, {_STATUS} FROM series GROUP BY 1", "hosp")
def _series_status(t):
    return features.series_status(weekly_series(t))
