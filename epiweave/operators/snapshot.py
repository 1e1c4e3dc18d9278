"""Filters, latest snapshots, value lists and top-k reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epiweave.functions.scalars import is_overall_observed
from epiweave.schemas import HIGH_LABELS


def latest(df: DataFrame, column: str, at: str | None = None) -> DataFrame:
    """Rows of the newest date, or of the given one.

    The maximum is a scalar subquery over the whole frame, so on a table stored
    by this column only one partition is read for the rows.
    """
    if at:
        return df.filter(F.col(column) == F.lit(at).cast("date"))
    return df.filter(F.col(column) == df.agg(F.max(column)).scalar())


def trailing(df: DataFrame, column: str, days: int = 28) -> DataFrame:
    """Rows from ``days`` before the newest date on, both ends included."""
    return df.filter(F.col(column) >= F.date_sub(df.agg(F.max(column)).scalar(), days))


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Equality filters for the given values; None or an empty text means no filter."""
    for column, value in values.items():
        if value not in (None, ""):
            df = df.filter(F.col(column) == value)
    return df


def newest_dates(df: DataFrame, date: str, rows: int, per_date: DataFrame | None = None) -> DataFrame:
    """Rows of the newest dates that together hold at least ``rows`` rows.

    The oldest date needed comes from the row counts per date (date, n): those given,
    or else counted here, which reads only the filter columns. On a table stored by date the scan of the rows is then
    cut to those dates, and a following top-n merges candidates of a few dates
    instead of n from every task of the whole table.
    """
    if per_date is None:
        per_date = df.groupBy(date).agg(F.count("*").alias("n"))
    # One row per date, so the running total is small.
    running = F.sum("n").over(Window.orderBy(F.col(date).desc()))
    enough = per_date.select(date, running.alias("total")).filter(F.col("total") >= rows)
    oldest = enough.agg(F.max(date)).scalar()
    return df.filter(oldest.isNull() | (F.col(date) >= oldest))


def newest_first(df: DataFrame, date: str, limit: int, *ties: str) -> DataFrame:
    return newest_dates(df, date, limit).orderBy(F.col(date).desc(), *ties).limit(limit)


def ari_activity(ari: DataFrame, week_end: str | None = None, geography: str | None = None) -> DataFrame:
    return where_equal(latest(ari, "week_end", week_end), geography=geography).orderBy("geography")


def ari_history(ari: DataFrame, geography: str | None = None, weeks: int = 52) -> DataFrame:
    """The last ``weeks`` weeks of one geography, or of each, newest first."""
    order = Window.partitionBy("geography").orderBy(F.col("week_end").desc())
    return (
        where_equal(ari, geography=geography)
        .select("week_end", "geography", "label", F.row_number().over(order).alias("weeks_back"))
        .filter(F.col("weeks_back") <= weeks)
        .orderBy(F.col("week_end").desc(), "geography")
    )


def hospitalizations(
    hosp: DataFrame,
    network: str | None = None,
    site: str | None = None,
    age_group: str = "Overall",
    limit: int = 200,
) -> DataFrame:
    rows = where_equal(
        hosp.filter(is_overall_observed(overall_age=False)),
        age_group=age_group,
        surveillance_network=network,
        site=site,
    ).select(
        "surveillance_network",
        "season",
        "week_ending_date",
        "mmwr_year",
        "mmwr_week",
        "age_group",
        "site",
        "weekly_rate",
        "cumulative_rate",
    )
    return newest_first(rows, "week_ending_date", limit, "surveillance_network", "site", "age_group")


def positivity(pos: DataFrame, pathogen: str | None = None, limit: int = 200) -> DataFrame:
    return newest_first(where_equal(pos, pathogen=pathogen), "week_end", limit, "pathogen")


def positivity_latest(pos: DataFrame) -> DataFrame:
    return latest(pos, "week_end").select("pathogen", "percent_test_positivity", "week_end").orderBy("pathogen")


def wastewater(ww: DataFrame, state: str | None = None, county: str | None = None, limit: int = 5000) -> DataFrame:
    """Site readings, newest first; ``county`` is a LIKE fragment, wildcards kept."""
    rows = where_equal(ww, wwtp_jurisdiction=state)
    if county:
        rows = rows.filter(F.col("county_names").like(f"%{county}%"))
    rows = rows.select(
        "wwtp_jurisdiction",
        "wwtp_id",
        "county_names",
        "county_fips",
        "population_served",
        "date_end",
        "ptc_15d",
        "detect_prop_15d",
        "percentile",
    )
    return newest_first(rows, "date_end", limit, "wwtp_id")


def wastewater_latest(ww: DataFrame) -> DataFrame:
    return latest(ww, "date_end").select(
        F.col("wwtp_jurisdiction").alias("state"),
        F.col("county_names").alias("county"),
        F.col("county_fips").alias("fips"),
        "wwtp_id",
        "population_served",
        "percentile",
        F.col("ptc_15d").alias("pct_change"),
        F.col("detect_prop_15d").alias("detection_rate"),
        "date_end",
    )


def by_percentile(sites: DataFrame, state: str | None = None, limit: int | None = None) -> DataFrame:
    """Latest sites by percentile, a missing percentile counting as 0."""
    order = [F.coalesce("percentile", F.lit(0.0)).desc(), F.col("wwtp_id")]
    ranked = where_equal(sites, state=state).orderBy(*order)
    return ranked if limit is None else ranked.limit(limit)


def with_display_defaults(sites: DataFrame) -> DataFrame:
    """Missing numbers read 0 and a missing county reads 'Unknown County'."""
    numbers = [c for c in ("population_served", "percentile", "pct_change", "detection_rate") if c in sites.columns]
    county = F.coalesce(F.nullif(F.col("county"), F.lit("")), F.lit("Unknown County"))
    return sites.na.fill(0, subset=numbers).withColumn("county", county)


def high_signal(sites: DataFrame, percentile: float = 80) -> DataFrame:
    return sites.filter(F.col("percentile") >= percentile)


def wastewater_county(ww: DataFrame, fips: str) -> DataFrame:
    return (
        ww.filter(F.col("county_fips") == fips)
        .select(
            "date_end",
            "percentile",
            "ptc_15d",
            "detect_prop_15d",
            "population_served",
            "county_names",
            "wwtp_jurisdiction",
        )
        .orderBy("date_end")
    )


def high_risk(ari: DataFrame) -> DataFrame:
    return latest(ari, "week_end").filter(F.col("label").isin(*HIGH_LABELS))


def current_label(ari: DataFrame, asked: DataFrame) -> DataFrame:
    """Latest label of the asked geographies; 'Unknown' where there is none."""
    now = latest(ari, "week_end").select("geography", "label", "week_end")
    return asked.select("geography").join(now, "geography", "left").withColumn(
        "label", F.coalesce("label", F.lit("Unknown"))
    )


def place_labels(ari: DataFrame) -> DataFrame:
    """Every known geography with its label in the newest week, else 'Unknown'."""
    newest = ari.agg(F.max("week_end")).scalar()
    label = F.max(F.when(F.col("week_end") == newest, F.col("label")))
    return ari.groupBy("geography").agg(F.coalesce(label, F.lit("Unknown")).alias("label"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def iso_dates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Date columns as 'yyyy-MM-dd' text; null stays null."""
    names = columns or [
        "week_end",
        "week_ending_date",
        "date_start",
        "date_end",
        "first_sample_date",
        "detected_date",
    ]
    present = [n for n in names if n in df.columns]
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in present})


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
