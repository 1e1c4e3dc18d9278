"""Week-over-week and season-over-season views of the weekly series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epiweave.functions.scalars import round_to


def week_over_week(series: DataFrame, latest_only: bool = True) -> DataFrame:
    """Change of each week against the week before, in percent to one place.

    0 where there is no earlier week or its rate is not positive.
    """
    order = Window.partitionBy("virus").orderBy("date")
    change = (F.col("rate") - F.col("previous")) / F.nullif(F.col("previous"), F.lit(0.0)) * 100
    out = series.withColumn("previous", F.coalesce(F.lag("rate").over(order), F.lit(0.0))).withColumn(
        "change_pct", F.when(F.col("previous") > 0, round_to(change, 1)).otherwise(F.lit(0.0))
    )
    if latest_only:
        back = Window.partitionBy("virus").orderBy(F.col("date").desc())
        out = out.withColumn("_back", F.row_number().over(back)).filter("_back = 1").drop("_back")
    return out


def last_seasons(seasons: DataFrame, count: int = 2) -> DataFrame:
    """Rows of the newest seasons of each network; 1 is the newest."""
    order = Window.partitionBy("surveillance_network").orderBy(F.col("season").desc())
    return seasons.withColumn("season_rank", F.dense_rank().over(order)).filter(F.col("season_rank") <= count)


def season_alignment(seasons: DataFrame) -> DataFrame:
    """Each season's epi-week next to the same week of the season before."""
    order = Window.partitionBy("surveillance_network", "mmwr_week").orderBy("season")
    return seasons.withColumn("previous_season", F.lag("season").over(order)).withColumn(
        "previous_rate", F.lag("avg_rate").over(order)
    )


def fill_missing_weeks(series: DataFrame) -> DataFrame:
    """Every week between a series' ends; missing rates on a straight line."""
    weekly = Window.partitionBy("virus").orderBy("date")
    before = weekly.rowsBetween(Window.unboundedPreceding, 0)
    # The later neighbour is read from a descending order, whose frame only grows.
    after = Window.partitionBy("virus").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    grid = (
        series.groupBy("virus")
        .agg(F.min("date").alias("first"), F.max("date").alias("last"))
        .select("virus", F.explode(F.expr("sequence(first, last, interval 7 days)")).alias("date"))
    )
    known = F.when(F.col("rate").isNotNull(), F.col("date"))
    joined = (
        grid.join(series, ["virus", "date"], "left")
        .withColumn("_d0", F.last(known, ignorenulls=True).over(before))
        .withColumn("_r0", F.last("rate", ignorenulls=True).over(before))
        .withColumn("_d1", F.last(known, ignorenulls=True).over(after))
        .withColumn("_r1", F.last("rate", ignorenulls=True).over(after))
    )
    span = F.nullif(F.date_diff("_d1", "_d0"), F.lit(0))
    line = F.col("_r0") + (F.col("_r1") - F.col("_r0")) * F.date_diff("date", "_d0") / span
    return joined.select(
        "virus", "date", F.coalesce("rate", line).alias("rate"), F.col("rate").isNull().alias("interpolated")
    )


def wastewater_rolling(ww: DataFrame, days: int = 90) -> DataFrame:
    """Site mean percentile over the trailing days, current reading included."""
    day = F.unix_date("date_end")
    span = Window.partitionBy("wwtp_id").orderBy(day).rangeBetween(-(days - 1), 0)
    return ww.select("wwtp_id", "date_end", "percentile", F.avg("percentile").over(span).alias("rolling_percentile"))


def lead_correlation(signal: DataFrame, rates: DataFrame, max_lead: int = 4) -> DataFrame:
    """Correlation of each virus' rate with the signal 0 … max_lead periods earlier.

    Both sides have one row per ``period`` (rates per virus and period), so the
    join and the windows run over aggregated series.
    """
    order = Window.partitionBy("virus").orderBy("period")
    leads = range(max_lead + 1)
    paired = rates.join(signal, "period").withColumns({f"_s{k}": F.lag("signal", k).over(order) for k in leads})
    wide = paired.groupBy("virus").agg(*(F.corr(f"_s{k}", "rate").alias(f"_c{k}") for k in leads))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("lead"), F.col(f"_c{k}").alias("corr")) for k in leads)))
    return wide.select("virus", pairs.alias("p")).select("virus", "p.lead", "p.corr")
