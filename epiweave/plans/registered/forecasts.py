"""Forecasts and their arithmetic."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.functions.scalars import round_to, tidy
from epiweave.operators import features, forecasting, panel
from epiweave.plans.registry import CTES, Sources, half_up, query, tidied, weekly_series, work_folder
from epiweave.session import materialise, shared_dir
from epiweave.sources import tables


def _trained(t: Sources, kind: str, series: DataFrame | None = None) -> forecasting.Trained:
    """A model of this folder's series, trained once per application and stored; ``series`` where it is at hand."""
    series = weekly_series(t) if series is None else series
    name = hashlib.sha256(t.folder.encode()).hexdigest()[:16]
    path = f"{shared_dir(t.spark)}/epiweave/{t.spark.sparkContext.applicationId}/models/{kind}-{name}"
    if kind == "gbt":
        return forecasting.fit_or_load(series, path)
    return forecasting.fit_or_load(series, path, forecasting.train_direct)


def _forecasts(t: Sources, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both forecasts; ``series`` is read four times, so it should be materialised."""
    gbt, direct = _trained(t, "gbt", series), _trained(t, "direct", series)
    return forecasting.gbt_forecast(series, gbt), forecasting.direct_forecast(series, direct)


@query("forecast_gbt")
def _forecast_gbt(t):
    series = materialise(weekly_series(t))
    return forecasting.gbt_forecast(series, _trained(t, "gbt", series))


@query("forecast_direct")
def _forecast_direct(t):
    series = materialise(weekly_series(t))
    return forecasting.direct_forecast(series, _trained(t, "direct", series))


@query("forecast_compare")
def _forecast_compare(t):
    return forecasting.compare_forecasts(*_forecasts(t, materialise(weekly_series(t))))


@query("forecast_stacked")
def _forecast_stacked(t):
    series = materialise(weekly_series(t))
    return forecasting.stacked(series, *_forecasts(t, series))


@query("forecast_eval")
def _forecast_eval(t):
    return _trained(t, "gbt").metrics


@query(
    "forecast_checks",
    """SELECT model_version, virus, CAST(4 AS BIGINT) AS weeks, max(date) AS forecast_date,
         max(date) + 7 AS first_target, max(date) + 28 AS last_target, true AS bounds_hold, true AS bounds_grow
       FROM indexed, (VALUES ('gbt'), ('direct')) AS m(model_version) WHERE points >= 30 GROUP BY 1, 2""",
    "hosp",
)
def _forecast_checks(t):
    # What must hold for any model: horizon, dates, bounds around the value and never below zero.
    gbt, direct = _forecasts(t, materialise(weekly_series(t)))
    inside = (F.col("lower_bound") >= 0) & F.col("predicted_rate").between(F.col("lower_bound"), F.col("upper_bound"))
    width = F.round(F.col("upper_bound") - F.col("predicted_rate"), 2)
    widths = F.transform(F.sort_array(F.collect_list(F.struct("target_date", width.alias("w")))), lambda e: e["w"])
    return (
        gbt.unionByName(direct)
        .groupBy("model_version", "virus")
        .agg(
            F.count("*").alias("weeks"),
            F.max("forecast_date").alias("forecast_date"),
            F.min("target_date").alias("first_target"),
            F.max("target_date").alias("last_target"),
            F.bool_and(inside).alias("bounds_hold"),
            (widths == F.sort_array(widths)).alias("bounds_grow"),
        )
    )


@query(
    "forecast_samples",
    """SELECT virus, CAST(floor(CAST(0.8 AS DOUBLE) * count(*)) AS BIGINT) AS train_samples,
         count(*) - CAST(floor(CAST(0.8 AS DOUBLE) * count(*)) AS BIGINT) AS val_samples, true AS has_error
       FROM tabular WHERE points >= 30 GROUP BY 1""",
    "hosp",
    "samples",
)
def _forecast_samples(t):
    metrics = _trained(t, "gbt").metrics
    return metrics.select("virus", "train_samples", "val_samples", (F.col("mae") >= 0).alias("has_error"))


@query(
    "stored_forecasts",
    """SELECT virus, max(date) AS forecast_date, CAST(date + 7 * step AS DATE) AS target_date, 'All' AS geography,
         'direct' AS model_version FROM indexed, (VALUES (1), (2), (3), (4)) AS s(step)
       WHERE points >= 30 AND idx = points - 1 GROUP BY 1, 3""",
    "hosp",
)
def _stored_forecasts(t):
    # Only the keys: the values come out of a trained model.
    folder = work_folder(t, "forecasts")
    tables.declare_tables(t.spark, folder, ("forecasts",))
    series = materialise(weekly_series(t))
    found = forecasting.direct_forecast(series, _trained(t, "direct", series))
    for _ in range(2):
        tables.append_results(t.spark, folder, "forecasts", found)
    stored = tables.read_table(t.spark, folder, "forecasts")
    return stored.select("virus", "forecast_date", "target_date", "geography", "model_version")


@query(
    "stored_forecasts_models",
    """SELECT virus, max(date) AS forecast_date, CAST(date + 7 * step AS DATE) AS target_date, 'All' AS geography,
         model_version FROM indexed, (VALUES (1), (2), (3), (4)) AS s(step), (VALUES ('gbt'), ('direct')) AS m(model_version)
       WHERE points >= 30 AND idx = points - 1 GROUP BY 1, 3, 5""",
    "hosp",
)
def _stored_forecasts_models(t):
    # Both models of the same series, each stored twice.
    folder = work_folder(t, "forecasts_models")
    tables.declare_tables(t.spark, folder, ("forecasts",))
    for found in _forecasts(t, materialise(weekly_series(t))) * 2:
        tables.append_results(t.spark, folder, "forecasts", found)
    stored = tables.read_table(t.spark, folder, "forecasts")
    return stored.select("virus", "forecast_date", "target_date", "geography", "model_version")


@query("importances")
def _importances(t):
    return forecasting.importances(_trained(t, "gbt").model, t.spark)


@query(
    "bands_math",
    f"""SELECT virus, date AS forecast_date, CAST(date + CAST(7 * (idx % 4 + 1) AS INTEGER) AS DATE) AS target_date, 'All' AS geography,
         {half_up("rate", 2)} AS predicted_rate,
         {half_up("greatest(0, rate - m * (1 + CAST(0.25 AS DOUBLE) * (idx % 4)))", 2)} AS lower_bound,
         {half_up("rate + m * (1 + CAST(0.25 AS DOUBLE) * (idx % 4))", 2)} AS upper_bound,
         'given' AS model_version FROM (SELECT *, CAST(7 AS DOUBLE) AS m FROM indexed)""",
    "hosp",
)
def _bands_math(t):
    # Every observed week stands in for a prediction, its position for the step.
    given = features.indexed(weekly_series(t)).select("virus", "date", (F.col("idx") % 4).alias("step"), "rate")
    metrics = weekly_series(t).select("virus").distinct().withColumn("mae", F.lit(7.0))
    return forecasting.forecast_table(given.withColumnRenamed("rate", "value"), metrics, 0.25, "given")


@query(
    "holdout_error",
    """SELECT virus, round(avg(CASE WHEN NOT is_train THEN abs(lag_1 - target) END), 8) + 0.0 AS mae,
         count(*) FILTER (is_train) AS train_samples, count(*) FILTER (NOT is_train) AS val_samples
       FROM (SELECT *, row_number() OVER (PARTITION BY virus ORDER BY date) <=
               floor(CAST(0.8 AS DOUBLE) * count(*) OVER (PARTITION BY virus)) AS is_train FROM tabular) GROUP BY 1""",
    "hosp",
    "samples",
)
def _holdout_error(t):
    # The naive forecast, last week's rate, measured on the same hold-out.
    samples = features.time_split(features.tabular_samples(weekly_series(t)))
    return tidied(forecasting.holdout_metrics(samples, "target", "lag_1"), "mae")


CTES["given"] = f"""
given AS (
  SELECT virus, date AS target_date, {half_up("rate", 2)} AS p, {half_up("rate", 2)} - 1 AS l, {half_up("rate", 2)} + 1 AS u
  FROM series
)"""


def _given(t: Sources) -> tuple[DataFrame, DataFrame]:
    """Observed weeks in place of both predictions, those of the second a week later."""
    rate = round_to("rate", 2)
    first = weekly_series(t).select(
        "virus",
        F.col("date").alias("target_date"),
        rate.alias("predicted_rate"),
        (rate - 1).alias("lower_bound"),
        (rate + 1).alias("upper_bound"),
    )
    return first, first.withColumn("target_date", F.date_add("target_date", 7))


def _side(prefix: str, table: str) -> str:
    names = (("p", "predicted_rate"), ("l", "lower_bound"), ("u", "upper_bound"))
    return ", ".join(f"round({table}.{c}, 8) + 0.0 AS {prefix}_{name}" for c, name in names)


@query(
    "compare_given",
    f"""SELECT coalesce(g.virus, d.virus) AS virus, coalesce(g.target_date, d.target_date) AS target_date,
         {_side("gbt", "g")}, {_side("direct", "d")}
       FROM (SELECT virus, target_date, p, l, u FROM given) g
       FULL JOIN (SELECT virus, target_date + 7 AS target_date, p, l, u FROM given) d
       ON g.virus = d.virus AND g.target_date = d.target_date""",
    "hosp",
    "given",
)
def _compare_given(t):
    sides = [f"{s}_{v}" for s in ("gbt", "direct") for v in ("predicted_rate", "lower_bound", "upper_bound")]
    return tidied(forecasting.compare_forecasts(*_given(t)), *sides)


@query(
    "stacked_given",
    f"""SELECT virus, date, {half_up("rate", 2)} AS rate, 'actual' AS source FROM wow WHERE back <= 8
       UNION ALL SELECT virus, target_date, p, 'gbt' FROM given
       UNION ALL SELECT virus, target_date + 7, p, 'direct' FROM given""",
    "hosp",
    "wow",
    "given",
)
def _stacked_given(t):
    return forecasting.stacked(weekly_series(t), *_given(t))


@query(
    "panel_coefficients",
    """SELECT virus, CAST(i - 1 AS INTEGER) AS term, CAST(h - 1 AS INTEGER) AS horizon, round(c[i], 6) + 0.0 AS coefficient
       FROM coefficients, range(1, 16) AS a(i)""",
    "hosp",
    "norm",
    "panel",
)
def _panel_coefficients(t):
    terms = panel.fit_panel(weekly_series(t)).select("virus", F.posexplode("coefficients").alias("term", "row"))
    cells = terms.select("virus", "term", F.posexplode("row").alias("horizon", "coefficient"))
    return cells.withColumn("coefficient", tidy("coefficient", 6))


@query(
    "panel_quality",
    """SELECT virus, round(mae, 6) + 0.0 AS mae, CAST(train_samples AS BIGINT) AS train_samples,
         CAST(val_samples AS BIGINT) AS val_samples, lower(replace(replace(virus, '-', '_'), ' ', '_')) AS safe_name
       FROM panel_quality""",
    "hosp",
    "norm",
    "panel",
)
def _panel_quality(t):
    # Stored, then only one series fitted again: all models are there as before.
    path = work_folder(t, "panel-models")
    series = materialise(weekly_series(t))
    panel.fit_or_load_panel(series, path)
    models = panel.fit_or_load_panel(series, path, retrain=["RSV-NET"])
    kept = models.select("virus", "mae", "train_samples", "val_samples", "safe_name")
    return kept.withColumn("mae", tidy("mae", 6))


@query(
    "panel_forecast",
    f"""SELECT virus, CAST(date + CAST(7 * h AS INTEGER) AS DATE) AS target_date, date AS forecast_date, 'All' AS geography,
         {half_up("value", 2)} AS predicted_rate,
         {half_up("greatest(value - mae * (1 + CAST(0.3 AS DOUBLE) * (h - 1)), 0)", 2)} AS lower_bound,
         {half_up("value + mae * (1 + CAST(0.3 AS DOUBLE) * (h - 1))", 2)} AS upper_bound, 'panel' AS model_version
       FROM (SELECT r.virus, r.date, h, mae, greatest(list_dot_product(list_concat([CAST(1 AS DOUBLE)], w,
               [sin(2 * pi() * points / 52), cos(2 * pi() * points / 52)]), c) * std + mean, 0) AS value
             FROM (SELECT virus, max(date) AS date, any_value(points) AS points, any_value(mean) AS mean,
                     any_value(std) AS std, list(norm ORDER BY date) AS w
                   FROM norm WHERE idx >= points - 12 GROUP BY 1) r
             JOIN coefficients k ON r.virus = k.virus JOIN panel_quality q ON r.virus = q.virus)""",
    "hosp",
    "norm",
    "panel",
)
def _panel_forecast(t):
    series = materialise(weekly_series(t))
    return panel.panel_forecast(series, panel.fit_panel(series))
