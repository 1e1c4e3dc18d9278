"""One direct forecast model per series, all fitted in one pass.

A sample of a series is the twelve normalised values before a week and the season's sine and cosine;
its targets are the four values from that week on. The sums of products of all samples of a series
(its Gram matrix, combined before the shuffle) are all that a least-squares fit needs, so a series
of any length is solved as one row of 15 x 19 numbers, by elimination in array functions. The step
features of ``forecasting.train_direct`` are linear in these fourteen, so both span the same models.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from epiweave.functions.scalars import clip_zero, safe_name, season_angle
from epiweave.operators.aggregates import series_stats
from epiweave.operators.features import HORIZON, STEPS, indexed, normalised, time_split
from epiweave.operators.forecasting import forecast_table, long_enough
from epiweave.session import materialise

#: Constant, twelve values, sine and cosine.
TERMS = STEPS + 3
#: Share of the number of samples added to the diagonal, but for the constant's: values of neighbouring weeks
#: are close to each other.
RIDGE = 1e-3

MODELS = StructType(
    [
        StructField("virus", StringType()),
        StructField("coefficients", ArrayType(ArrayType(DoubleType()))),
        StructField("mean", DoubleType()),
        StructField("std", DoubleType()),
        StructField("mae", DoubleType()),
        StructField("train_samples", LongType()),
        StructField("val_samples", LongType()),
        StructField("safe_name", StringType()),
    ]
)


def _terms(window: Column | str, position: Column | str) -> Column:
    window = F.col(window) if isinstance(window, str) else window
    angle = season_angle(position)
    return F.concat(F.array(F.lit(1.0)), window, F.array(F.sin(angle), F.cos(angle)))


def panel_samples(series: DataFrame) -> DataFrame:
    """(virus, date, x, y, is_train): terms and targets of every week that has both; the first 0.8 train."""
    order = Window.partitionBy("virus").orderBy("date")
    scaled = indexed(normalised(series))
    samples = (
        scaled.withColumn("window", F.collect_list("norm").over(order.rowsBetween(-STEPS, -1)))
        .withColumn("y", F.collect_list("norm").over(order.rowsBetween(0, HORIZON - 1)))
        .filter((F.col("idx") >= STEPS) & (F.col("idx") < F.col("points") - HORIZON))
        .select("virus", "date", _terms("window", "idx").alias("x"), "y")
    )
    return time_split(samples)


def gram(samples: DataFrame) -> DataFrame:
    """(virus, n, system): per series the rows [X'X + ridge | X'y] of its normal equations."""
    x, y = F.col("x"), F.col("y")

    def both(i: int, j: int) -> Column:
        other = x[j] if j < TERMS else y[j - TERMS]
        return F.sum(x[i] * other).alias(f"s{i}_{j}")

    sums = [both(i, j) for i in range(TERMS) for j in range(i, TERMS + HORIZON)]
    summed = samples.groupBy("virus").agg(F.count("*").alias("n"), *sums)

    def entry(i: int, j: int) -> Column:
        product = F.col(f"s{min(i, j)}_{max(i, j)}") if j < TERMS else F.col(f"s{i}_{j}")
        return product + F.col("n") * F.lit(RIDGE) if i == j > 0 else product

    rows = (F.array(*(entry(i, j) for j in range(TERMS + HORIZON))) for i in range(TERMS))
    return summed.select("virus", "n", F.array(*rows).alias("system"))


def solved(system: Column) -> Column:
    """Elimination of each term in turn; the last columns are then the coefficients, (term, horizon).

    The matrix is symmetric and, with the ridge, positive definite: no pivot is zero and no rows are exchanged.
    """

    def eliminate(rows: Column, k: Column) -> Column:
        pivot = F.get(rows, k)
        unit = F.transform(pivot, lambda v: v / F.get(pivot, k))
        return F.transform(
            rows,
            lambda row, i: F.when(i == k, unit).otherwise(F.zip_with(row, unit, lambda v, u: v - F.get(row, k) * u)),
        )

    done = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), system, eliminate)
    return F.transform(done, lambda row: F.slice(row, TERMS + 1, HORIZON))


def _predicted(coefficients: str, x: str) -> Column:
    """The four predictions of one sample, normalised."""

    def one(h: int) -> Column:
        products = F.zip_with(F.col(x), F.col(coefficients), lambda v, row: v * row[h])
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    return F.array(*(one(h) for h in range(HORIZON)))


def fit_panel(series: DataFrame) -> DataFrame:
    """One model (a row of ``MODELS``) for each series of at least thirty points; the others have none.

    ``mae`` is the mean error over the held-out samples and all four horizons, in rates.
    """
    usable = long_enough(series)
    samples = materialise(panel_samples(usable))
    models = gram(samples.filter("is_train")).select("virus", solved(F.col("system")).alias("coefficients"))
    scored = samples.join(models, "virus").withColumn("p", _predicted("coefficients", "x"))
    misses = F.zip_with("p", "y", lambda p, y: F.abs(p - y))
    error = F.aggregate(misses, F.lit(0.0), lambda total, e: total + e) / HORIZON
    quality = scored.groupBy("virus").agg(
        F.avg(F.when(~F.col("is_train"), error)).alias("error"),
        F.count_if("is_train").alias("train_samples"),
        F.count_if(~F.col("is_train")).alias("val_samples"),
    )
    stats = series_stats(usable).select("virus", "mean", "std")
    fitted = models.join(stats, "virus").join(quality, "virus").withColumn("mae", F.col("error") * F.col("std"))
    return fitted.withColumn("safe_name", safe_name("virus")).select(*MODELS.names)


def panel_forecast(series: DataFrame, models: DataFrame) -> DataFrame:
    """Forecast rows of each series that has a model, from its last twelve weeks and the model's own scale."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("idx", "rate"))), lambda p: p["rate"])
    recent = (
        indexed(series)
        .filter(F.col("idx") >= F.col("points") - STEPS)
        .groupBy("virus", "points")
        .agg(F.max("date").alias("date"), ordered.alias("rates"))
        .filter(F.col("points") >= STEPS)
        .join(models, "virus")
    )
    scaled = F.transform("rates", lambda r: (r - F.col("mean")) / F.col("std"))
    scored = recent.withColumn("x", _terms(scaled, "points")).withColumn("p", _predicted("coefficients", "x"))
    values = F.transform("p", lambda p: clip_zero(p * F.col("std") + F.col("mean")))
    steps = scored.select("virus", "date", F.posexplode(values).alias("step", "value"))
    return forecast_table(steps, models, 0.3, "panel")


# --- Persistence ----------------------------------------------------------------


def load_models(spark: SparkSession, path: str) -> DataFrame:
    """Stored models, one folder per ``safe_name``; empty where none have been stored."""
    try:
        return spark.read.schema(MODELS).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MODELS)


def store_models(models: DataFrame, path: str) -> None:
    """Replace the stored models of these series; names that read alike share a folder and all stay."""
    models = materialise(models)
    stored = load_models(models.sparkSession, path)
    beside = stored.join(models.select("safe_name").distinct(), "safe_name", "left_semi")
    others = materialise(beside.join(models.select("virus"), "virus", "left_anti").select(*MODELS.names))
    (
        models.unionByName(others)
        .repartition("safe_name")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("safe_name")
        .parquet(path)
    )


def fit_or_load_panel(series: DataFrame, path: str, retrain: list[str] | bool = False) -> DataFrame:
    """The stored models; series without one, and those named in ``retrain`` (True: all), are fitted and stored."""
    stored = load_models(series.sparkSession, path)
    if retrain is not True:
        again = F.col("virus").isin(retrain) if retrain else F.lit(False)
        series = series.join(stored.filter(~again).select("virus"), "virus", "left_anti")
    store_models(fit_panel(series), path)
    return load_models(series.sparkSession, path)
