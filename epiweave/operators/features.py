"""Supervised samples from weekly series, for all series in one pass.

Input is (virus, date, rate) with one row per week, so a partition holds one
series and its size is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epiweave.functions.scalars import round_to, season_angle
from epiweave.operators.aggregates import series_stats

TABULAR_FEATURES = [
    "lag_1",
    "lag_2",
    "lag_4",
    "lag_8",
    "roll_avg_4",
    "roll_avg_8",
    "roll_std_4",
    "diff_1",
    "week_sin",
    "week_cos",
]
STEPS, HORIZON = 12, 4


def indexed(series: DataFrame) -> DataFrame:
    """Adds the 0-based position ``idx`` and the series length ``points``."""
    order = Window.partitionBy("virus").orderBy("date")
    return series.withColumn("idx", F.row_number().over(order) - 1).withColumn(
        "points", F.count("*").over(Window.partitionBy("virus"))
    )


def tabular_samples(series: DataFrame, lookback: int = 8) -> DataFrame:
    """Ten features of the weeks before each target week.

    The first ``lookback`` weeks lack history and the last week is never a
    target; series shorter than ``lookback + 4`` give no sample.
    """
    order = Window.partitionBy("virus").orderBy("date")
    past4, past8 = order.rowsBetween(-4, -1), order.rowsBetween(-8, -1)
    angle = season_angle("idx")
    return (
        indexed(series)
        .withColumns({f"lag_{k}": F.lag("rate", k).over(order) for k in (1, 2, 4, 8)})
        .withColumns(
            {
                "roll_avg_4": F.avg("rate").over(past4),
                "roll_avg_8": F.avg("rate").over(past8),
                "roll_std_4": F.stddev_pop("rate").over(past4),
            }
        )
        .filter((F.col("points") >= lookback + 4) & (F.col("idx") >= lookback) & (F.col("idx") < F.col("points") - 1))
        .select(
            "virus",
            "date",
            "idx",
            "lag_1",
            "lag_2",
            "lag_4",
            "lag_8",
            "roll_avg_4",
            "roll_avg_8",
            "roll_std_4",
            (F.col("lag_1") - F.col("lag_2")).alias("diff_1"),
            F.sin(angle).alias("week_sin"),
            F.cos(angle).alias("week_cos"),
            F.col("rate").alias("target"),
        )
    )


def normalised(series: DataFrame) -> DataFrame:
    """(rate − mean) / std with the statistics of the whole series kept alongside."""
    whole = Window.partitionBy("virus")
    return (
        series.withColumn("mean", F.avg("rate").over(whole))
        .withColumn("std", F.stddev_pop("rate").over(whole) + F.lit(1e-8))
        .withColumn("norm", (F.col("rate") - F.col("mean")) / F.col("std"))
    )


def denormalise(df: DataFrame, stats: DataFrame, column: str) -> DataFrame:
    """Back to rates with per-series (mean, std), one row each."""
    joined = df.join(stats.select("virus", "mean", "std"), "virus")
    return joined.withColumn(column, F.col(column) * F.col("std") + F.col("mean")).drop("mean", "std")


def step_features(window_column: str, start: Column | str, steps: int = STEPS) -> Column:
    """Array of (value, lag1, lag2, roll_avg, week_sin) per step of a window array.

    Lags that would leave the window take the step's own value, and the mean
    covers up to four values ending at the step. ``start`` is the series
    position of the first step.
    """
    values = F.col(window_column)
    start = F.col(start) if isinstance(start, str) else start

    def at(position):
        return F.get(values, position)

    def one_step(j):
        own = at(j)
        tail = F.slice(values, F.greatest(j - 3, F.lit(0)) + 1, F.least(j + 1, F.lit(4)))
        mean = F.aggregate(tail, F.lit(0.0), lambda acc, x: acc + x) / F.size(tail)
        return F.struct(
            j.alias("step"),
            own.alias("value"),
            F.when(j > 0, at(j - 1)).otherwise(own).alias("lag1"),
            F.when(j > 1, at(j - 2)).otherwise(own).alias("lag2"),
            mean.alias("roll_avg"),
            F.sin(season_angle(start + j)).alias("week_sin"),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), one_step)


def sequence_samples(series: DataFrame, value: str = "rate") -> DataFrame:
    """Twelve steps of five features and the next four values per sample.

    Samples start once twelve values precede and stop one short of the last
    complete target; series shorter than sixteen points give none.
    """
    order = Window.partitionBy("virus").orderBy("date")
    past, ahead = order.rowsBetween(-STEPS, -1), order.rowsBetween(0, HORIZON - 1)
    return (
        indexed(series)
        .withColumn("window", F.collect_list(value).over(past))
        .withColumn("targets", F.collect_list(value).over(ahead))
        .filter(
            (F.col("points") >= STEPS + HORIZON)
            & (F.col("idx") >= STEPS)
            & (F.col("idx") < F.col("points") - HORIZON)
        )
        .withColumn("steps", step_features("window", F.col("idx") - STEPS))
        .drop("window", "points")
    )


def latest_window(series: DataFrame, value: str = "rate") -> DataFrame:
    """The last twelve values of each series as step features, with the last date."""
    back = Window.partitionBy("virus").orderBy(F.col("date").desc())
    recent = (
        indexed(series)
        .withColumn("back", F.row_number().over(back))
        .filter(F.col("back") <= STEPS)
        .groupBy("virus", "points")
        .agg(
            F.max("date").alias("date"),
            F.transform(F.sort_array(F.collect_list(F.struct("idx", value))), lambda p: p[value]).alias("window"),
        )
        .filter(F.col("points") >= STEPS)
    )
    return recent.withColumn("steps", step_features("window", F.col("points").cast("int") - STEPS))


def time_split(samples: DataFrame, share: float = 0.8, order: str = "date") -> DataFrame:
    """Adds ``is_train``: the first share of each series' samples in time order."""
    in_time = Window.partitionBy("virus").orderBy(order)
    rank = F.row_number().over(in_time)
    train = F.floor(F.lit(share) * F.count("*").over(Window.partitionBy("virus")))
    return samples.withColumn("is_train", rank <= train)


def recent_rates(series: DataFrame, count: int = 8) -> DataFrame:
    """The last observed rates to two places, labelled 'Week -k'."""
    back = Window.partitionBy("virus").orderBy(F.col("date").desc())
    return (
        series.withColumn("weeks_back", F.row_number().over(back))
        .filter(F.col("weeks_back") <= count)
        .select(
            "virus",
            "date",
            F.concat(F.lit("Week -"), F.col("weeks_back").cast("string")).alias("label"),
            round_to("rate", 2).alias("rate"),
        )
    )


def series_status(series: DataFrame, min_train: int = 30, min_window: int = 12, min_recent: int = 8) -> DataFrame:
    """Which analyses each series is long enough for, as a status, not an error."""

    def status(limit: int):
        return F.when(F.col("points") >= limit, "ok").otherwise("insufficient_data")

    return series_stats(series).select(
        "virus",
        "points",
        status(min_train).alias("training"),
        status(min_window).alias("direct_forecast"),
        status(min_recent).alias("recursive_forecast"),
    )
