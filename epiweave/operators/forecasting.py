"""Four-week forecasts of all weekly series at once, with MLlib.

``train_recursive`` fits boosted trees on the tabular samples and predicts one
week at a time, feeding each prediction back. ``train_direct`` fits one
regression per horizon on the normalised twelve-week windows. Both fit one model
on the samples of every series they are given; pass a single virus for a model
of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epiweave.functions.scalars import add_weeks, clip_zero, round_to, season_angle
from epiweave.operators.aggregates import series_stats
from epiweave.operators.features import (
    HORIZON,
    TABULAR_FEATURES,
    latest_window,
    normalised,
    recent_rates,
    sequence_samples,
    tabular_samples,
    time_split,
)
from epiweave.schemas import TABLES
from epiweave.session import materialise

MIN_TRAIN_POINTS = 30
RECENT = 8


@dataclass(frozen=True)
class Trained:
    """A fitted model and its hold-out metrics, one row per virus."""

    model: PipelineModel
    metrics: DataFrame


def long_enough(series: DataFrame, points: int = MIN_TRAIN_POINTS) -> DataFrame:
    count = F.count("*").over(Window.partitionBy("virus"))
    return series.withColumn("_n", count).filter(F.col("_n") >= points).drop("_n")


# --- Recursive boosted-tree forecast ------------------------------------------


def train_recursive(series: DataFrame, max_iter: int = 200, seed: int = 42) -> Trained:
    samples = materialise(time_split(tabular_samples(long_enough(series))))
    stages = [
        VectorAssembler(inputCols=TABULAR_FEATURES, outputCol="features"),
        GBTRegressor(
            labelCol="target",
            maxIter=max_iter,
            maxDepth=5,
            stepSize=0.05,
            subsamplingRate=0.8,
            featureSubsetStrategy="0.8",
            seed=seed,
        ),
    ]
    model = Pipeline(stages=stages).fit(samples.filter("is_train"))
    return Trained(model, materialise(holdout_metrics(model.transform(samples), "target", "prediction")))


def holdout_metrics(predicted: DataFrame, target: str, prediction: str) -> DataFrame:
    """Mean absolute error on the later samples, and both sample counts."""
    held_out = ~F.col("is_train")
    return predicted.groupBy("virus").agg(
        F.avg(F.when(held_out, F.abs(F.col(prediction) - F.col(target)))).alias("mae"),
        F.count_if(F.col("is_train")).alias("train_samples"),
        F.count_if(held_out).alias("val_samples"),
    )


def importances(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """Feature weights of the boosted trees, largest first (ten rows)."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = list(zip(TABULAR_FEATURES, weights, strict=True))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def last_values(series: DataFrame) -> DataFrame:
    """(virus, date, points, recent): the last eight rates of each series, oldest first."""
    back = Window.partitionBy("virus").orderBy(F.col("date").desc())
    count = F.count("*").over(Window.partitionBy("virus"))
    rows = series.withColumn("_back", F.row_number().over(back)).withColumn("points", count)
    rates = F.sort_array(F.collect_list(F.struct("date", "rate")))
    return (
        rows.filter(F.col("_back") <= RECENT)
        .groupBy("virus", "points")
        .agg(F.max("date").alias("date"), F.transform(rates, lambda p: p["rate"]).alias("recent"))
        .filter(F.size("recent") == RECENT)
    )


def _array_mean(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x) / F.size(array)


def next_week_features(state: DataFrame) -> DataFrame:
    """The tabular features of the week after each (recent, points) state."""

    def back(k: int) -> Column:
        return F.get(F.col("recent"), F.lit(RECENT - k))

    last4 = F.slice("recent", RECENT - 3, 4)
    angle = season_angle("points")
    with_mean = state.withColumns(
        {
            "lag_1": back(1),
            "lag_2": back(2),
            "lag_4": back(4),
            "lag_8": back(8),
            "roll_avg_4": _array_mean(last4),
            "roll_avg_8": _array_mean(F.col("recent")),
            "diff_1": back(1) - back(2),
            "week_sin": F.sin(angle),
            "week_cos": F.cos(angle),
        }
    )
    spread = F.transform(last4, lambda x: (x - F.col("roll_avg_4")) * (x - F.col("roll_avg_4")))
    return with_mean.withColumn("roll_std_4", F.sqrt(_array_mean(spread)))


def forecast_recursive(trained: Trained, series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """(virus, date, step, value) for the weeks after each series' end."""
    state = last_values(series).withColumn("values", F.array().cast("array<double>"))
    for _ in range(horizon):
        scored = trained.model.transform(next_week_features(state))
        value = clip_zero("prediction")
        state = scored.select(
            "virus",
            "date",
            (F.col("points") + 1).alias("points"),
            F.concat(F.slice("recent", 2, RECENT - 1), F.array(value)).alias("recent"),
            F.concat("values", F.array(value)).alias("values"),
        )
    return state.select("virus", "date", F.posexplode("values").alias("step", "value"))


# --- Direct forecast, one regression per horizon ------------------------------


def _with_vector(df: DataFrame) -> DataFrame:
    flat = F.flatten(
        F.transform("steps", lambda s: F.array(s["value"], s["lag1"], s["lag2"], s["roll_avg"], s["week_sin"]))
    )
    return df.withColumn("features", array_to_vector(flat))


def _regressor(horizon: int, kind: str, max_iter: int):
    target = f"target_{horizon}"
    if kind == "gbt":
        return GBTRegressor(labelCol=target, predictionCol=f"pred_{horizon}", maxIter=max_iter, seed=42)
    # A little ridge: the lag features repeat each other exactly.
    return LinearRegression(labelCol=target, predictionCol=f"pred_{horizon}", regParam=1e-3, solver="normal")


def train_direct(series: DataFrame, kind: str = "linear", max_iter: int = 20) -> Trained:
    usable = materialise(long_enough(series))
    stats = series_stats(usable)
    samples = time_split(sequence_samples(normalised(usable), "norm"), order="date")
    targets = {f"target_{h}": F.get(F.col("targets"), F.lit(h)) for h in range(HORIZON)}
    samples = _with_vector(materialise(samples.withColumns(targets).drop("mean", "std")))
    training = samples.filter("is_train")
    model = PipelineModel([_regressor(h, kind, max_iter).fit(training) for h in range(HORIZON)])
    scored = model.transform(samples)
    pairs = F.explode(
        F.array(*(F.struct(F.col(f"pred_{h}").alias("p"), F.col(f"target_{h}").alias("y")) for h in range(HORIZON)))
    )
    errors = scored.select("virus", "is_train", pairs.alias("pair")).join(stats, "virus")
    held_out = ~F.col("is_train")
    error = F.abs(F.col("pair.p") - F.col("pair.y")) * F.col("std")
    metrics = errors.groupBy("virus").agg(
        F.avg(F.when(held_out, error)).alias("mae"),
        (F.count_if(F.col("is_train")) / HORIZON).cast("long").alias("train_samples"),
        (F.count_if(held_out) / HORIZON).cast("long").alias("val_samples"),
    )
    return Trained(model, materialise(metrics))


def forecast_direct(trained: Trained, series: DataFrame) -> DataFrame:
    """(virus, date, step, value) from the last twelve weeks of each series."""
    window = latest_window(normalised(series), "norm")
    scored = trained.model.transform(_with_vector(window))
    stats = series_stats(series).select("virus", "mean", "std")
    values = F.array(*(clip_zero(F.col(f"pred_{h}") * F.col("std") + F.col("mean")) for h in range(HORIZON)))
    return scored.join(stats, "virus").select("virus", "date", F.posexplode(values).alias("step", "value"))


# --- Assembly -----------------------------------------------------------------


def with_bounds(forecast: DataFrame, step_growth: float) -> DataFrame:
    """Bounds of mae·(1 + growth·step) around each value, clipped at zero."""
    margin = F.col("mae") * (F.lit(1.0) + F.lit(step_growth) * F.col("step"))
    return forecast.withColumns(
        {
            "predicted_rate": round_to("value", 2),
            "lower_bound": round_to(clip_zero(F.col("value") - margin), 2),
            "upper_bound": round_to(F.col("value") + margin, 2),
        }
    )


def forecast_table(forecast: DataFrame, metrics: DataFrame, step_growth: float, version: str) -> DataFrame:
    """Rows of the forecasts table; the base date is the last date of the series."""
    bounded = with_bounds(forecast.join(metrics.select("virus", "mae"), "virus"), step_growth)
    return bounded.select(
        F.col("date").alias("forecast_date"),
        add_weeks("date", F.col("step") + 1).alias("target_date"),
        F.lit("All").alias("geography"),
        "virus",
        "predicted_rate",
        "lower_bound",
        "upper_bound",
        F.lit(version).alias("model_version"),
    )


def _none(series: DataFrame) -> DataFrame:
    return series.sparkSession.createDataFrame([], TABLES["forecasts"].schema)


def gbt_forecast(series: DataFrame, trained: Trained | None = None, max_iter: int = 200) -> DataFrame:
    """Forecast rows of every series that is long enough; the others have none."""
    series = materialise(long_enough(series))
    if series.isEmpty():
        return _none(series)
    trained = trained or train_recursive(series, max_iter)
    return forecast_table(forecast_recursive(trained, series), trained.metrics, 0.25, "gbt")


def direct_forecast(series: DataFrame, trained: Trained | None = None) -> DataFrame:
    """As ``gbt_forecast``, from the direct model."""
    series = materialise(long_enough(series))
    if series.isEmpty():
        return _none(series)
    trained = trained or train_direct(series)
    return forecast_table(forecast_direct(trained, series), trained.metrics, 0.3, "direct")


def compare_forecasts(gbt: DataFrame, direct: DataFrame) -> DataFrame:
    """Both forecasts side by side; a week only one of them has stays."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        values = ["predicted_rate", "lower_bound", "upper_bound"]
        return df.select("virus", "target_date", *(F.col(v).alias(f"{prefix}_{v}") for v in values))

    return side(gbt, "gbt").join(side(direct, "direct"), ["virus", "target_date"], "full")


def stacked(series: DataFrame, gbt: DataFrame, direct: DataFrame) -> DataFrame:
    """Recent actual rates and both forecasts in one long table."""
    actual = recent_rates(series).select("virus", "date", "rate", F.lit("actual").alias("source"))

    def tagged(df: DataFrame, source: str) -> DataFrame:
        return df.select(
            "virus",
            F.col("target_date").alias("date"),
            F.col("predicted_rate").alias("rate"),
            F.lit(source).alias("source"),
        )

    return actual.unionByName(tagged(gbt, "gbt")).unionByName(tagged(direct, "direct"))


# --- Persistence --------------------------------------------------------------


def save(trained: Trained, path: str) -> None:
    """Model and metrics under one folder."""
    trained.model.write().overwrite().save(f"{path}/model")
    trained.metrics.write.mode("overwrite").parquet(f"{path}/metrics")


def load(spark: SparkSession, path: str) -> Trained | None:
    """The stored model, or None where none has been saved yet."""
    try:
        metrics = spark.read.parquet(f"{path}/metrics")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Trained(PipelineModel.load(f"{path}/model"), metrics)


def fit_or_load(
    series: DataFrame, path: str, train: Callable[..., Trained] = train_recursive, retrain: bool = False, **options
) -> Trained:
    """Train and store when asked to or when nothing is stored, else load."""
    stored = None if retrain else load(series.sparkSession, path)
    if stored is not None:
        return stored
    trained = train(series, **options)
    save(trained, path)
    return trained
