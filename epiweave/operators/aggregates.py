"""Grouped statistics over the surveillance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epiweave.functions.scalars import is_overall_observed, risk_level, round_to, tidy
from epiweave.operators.snapshot import ari_history, high_risk, latest, trailing
from epiweave.schemas import HIGH_LABELS


def weekly_trends(hosp: DataFrame) -> DataFrame:
    """Average rate over all sites by network and week, oldest week first."""
    return _weekly_rates(hosp).orderBy("week_ending_date", "virus")


def _weekly_rates(hosp: DataFrame) -> DataFrame:
    return (
        hosp.filter(is_overall_observed())
        .groupBy(F.col("surveillance_network").alias("virus"), "week_ending_date")
        .agg(F.avg("weekly_rate").alias("avg_rate"))
    )


def virus_series(hosp: DataFrame, network: str | None = None, min_points: int = 0) -> DataFrame:
    """The weekly series (virus, date, rate); series below ``min_points`` drop out."""
    series = _weekly_rates(hosp).select(
        "virus", F.col("week_ending_date").alias("date"), F.col("avg_rate").alias("rate")
    )
    if network is not None:
        series = series.filter(F.col("virus") == network)
    if min_points:
        points = F.count("*").over(Window.partitionBy("virus"))
        series = series.withColumn("_points", points).filter(F.col("_points") >= min_points).drop("_points")
    return series


def risk_distribution(ari: DataFrame) -> DataFrame:
    """Places of the latest week by label, the most frequent label first."""
    counted = latest(ari, "week_end").groupBy("label").agg(F.count("*").alias("count"))
    return counted.orderBy(F.col("count").desc(), "label")


def risk_share(ari: DataFrame) -> DataFrame:
    """Label counts as a percentage of all tracked geographies, at most 100."""
    tracked = ari.agg(F.count_distinct("geography")).scalar()
    share = F.lit(100.0) * F.col("count") / F.greatest(tracked, F.lit(1))
    return risk_distribution(ari).withColumn("share", tidy(F.least(F.lit(100.0), share)))


def latest_dates(ari: DataFrame, hosp: DataFrame, pos: DataFrame) -> DataFrame:
    spark = ari.sparkSession
    return spark.range(1).select(
        ari.agg(F.max("week_end")).scalar().alias("ari_activity"),
        hosp.agg(F.max("week_ending_date")).scalar().alias("hospitalizations"),
        pos.agg(F.max("week_end")).scalar().alias("test_positivity"),
    )


def state_counts(ari: DataFrame) -> DataFrame:
    """Tracked geographies and latest-week high-risk rows."""
    spark = ari.sparkSession
    return spark.range(1).select(
        ari.agg(F.count_distinct("geography")).scalar().alias("total_states_tracked"),
        high_risk(ari).agg(F.count("*")).scalar().alias("high_risk_states"),
    )


def wastewater_summary(ww: DataFrame) -> DataFrame:
    return latest(ww, "date_end").agg(
        F.count_distinct("wwtp_id").alias("sites"),
        F.count_distinct("county_fips").alias("counties"),
        F.avg("percentile").alias("avg_percentile"),
        F.max("date_end").alias("latest_date"),
        F.count("*").alias("readings"),
    )


def wastewater_states(ww: DataFrame) -> DataFrame:
    """Latest readings by state, the highest average percentile first."""
    return (
        latest(ww, "date_end")
        .groupBy(F.col("wwtp_jurisdiction").alias("state"))
        .agg(
            F.count_distinct("wwtp_id").alias("sites"),
            F.count_distinct("county_fips").alias("counties"),
            F.avg("percentile").alias("avg_percentile"),
            F.avg("ptc_15d").alias("avg_pct_change"),
        )
        .orderBy(F.col("avg_percentile").desc_nulls_last(), "state")
    )


def detection_average(sites: DataFrame) -> DataFrame:
    """Mean detection rate with missing values counted as 0."""
    return sites.agg(F.avg(F.coalesce("detection_rate", F.lit(0.0))).alias("avg_detection"))


def age_heatmap(hosp: DataFrame, network: str | None = None) -> DataFrame:
    """Average rate by week and age group, the all-ages stratum left out; oldest week first."""
    rows = hosp.filter(is_overall_observed(overall_age=False) & (F.col("age_group") != "Overall"))
    if network is not None:
        rows = rows.filter(F.col("surveillance_network") == network)
    rates = rows.groupBy("surveillance_network", "week_ending_date", "age_group").agg(F.avg("weekly_rate").alias("rate"))
    return rates.orderBy("week_ending_date", "age_group", "surveillance_network")


def heatmap_grid(heatmap: DataFrame, age_groups: list[str], weeks: int | None = None) -> DataFrame:
    """One row per network and week, one column per age group, absent cells 0.

    ``weeks`` keeps the newest weeks of each network, axis and cells alike.
    """
    grid = heatmap.groupBy("surveillance_network", "week_ending_date").pivot("age_group", age_groups).agg(
        F.max("rate")
    )
    if weeks is not None:
        order = Window.partitionBy("surveillance_network").orderBy(F.col("week_ending_date").desc())
        grid = grid.withColumn("_back", F.row_number().over(order)).filter(F.col("_back") <= weeks).drop("_back")
    return grid.na.fill(0.0, subset=age_groups)


def season_comparison(hosp: DataFrame) -> DataFrame:
    """Average rate by network, season and week of the season's years, in that order."""
    return (
        hosp.filter(is_overall_observed())
        .groupBy("surveillance_network", "season", "mmwr_week")
        .agg(F.avg("weekly_rate").alias("avg_rate"))
        .orderBy("surveillance_network", "season", "mmwr_week")
    )


def current_rates(hosp: DataFrame) -> DataFrame:
    """Latest-week average per network, rounded to 2 places."""
    return (
        latest(hosp, "week_ending_date")
        .filter(is_overall_observed())
        .groupBy("surveillance_network")
        .agg(round_to(F.avg("weekly_rate"), 2).alias("rate"))
    )


def trailing_rates(hosp: DataFrame, days: int = 28) -> DataFrame:
    return (
        trailing(hosp, "week_ending_date", days)
        .filter(is_overall_observed())
        .groupBy("surveillance_network")
        .agg(F.avg("weekly_rate").alias("avg_rate"))
    )


def state_stats(ari: DataFrame, weeks: int = 52) -> DataFrame:
    """Per geography over its last weeks: weeks at a high level, mean level."""
    level = risk_level("label")
    return (
        ari_history(ari, weeks=weeks)
        .groupBy("geography")
        .agg(
            F.count("*").alias("weeks"),
            F.count_if(level >= 4).alias("high_weeks"),
            F.avg(level).alias("avg_level"),
        )
    )


def series_stats(series: DataFrame, key: str = "virus", value: str = "rate") -> DataFrame:
    """Mean and population deviation of each whole series, the latter kept above 0."""
    return series.groupBy(key).agg(
        F.avg(value).alias("mean"), (F.stddev_pop(value) + F.lit(1e-8)).alias("std"), F.count("*").alias("points")
    )


def dominant_pathogen(pos: DataFrame) -> DataFrame:
    """The pathogen with the highest latest positivity; ties go to the first name."""
    top = latest(pos, "week_end").orderBy(F.col("percent_test_positivity").desc(), "pathogen")
    return top.select("pathogen", "percent_test_positivity").limit(1)


def positivity_record(pos: DataFrame) -> DataFrame:
    """Latest positivity of the three main pathogens in one row, absent ones 0."""

    def value(pathogen: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("pathogen") == pathogen, F.col("percent_test_positivity"))), F.lit(0.0))

    return latest(pos, "week_end").agg(
        value("COVID-19").alias("covid"), value("Influenza").alias("flu"), value("RSV").alias("rsv")
    )


def series_lists(df: DataFrame, key: str | list[str], order: str, value: str) -> DataFrame:
    """One row per key: its (order, value) points as a sorted array.

    Meant for aggregated series, whose length is bounded by the calendar.
    """
    keys = [key] if isinstance(key, str) else key
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("points"))


def high_risk_list(ari: DataFrame) -> DataFrame:
    """High-risk geographies of the latest week as one sorted array."""
    return high_risk(ari).agg(F.sort_array(F.collect_list("geography")).alias("high_risk_states"))


def high_label_rows(ari: DataFrame) -> DataFrame:
    return ari.filter(F.col("label").isin(*HIGH_LABELS))
