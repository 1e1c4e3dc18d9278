"""Surveillance tables derived from the star-schema test tables.

Every function reads whole Parquet tables and stays lazy, so column pruning and
filters of the calling query still reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_schemas: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One test table; its schema is read from the files once per application."""
    path = f"{folder}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _schemas:
        _schemas[key] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[key]).parquet(path)


def _saturday(column: str) -> str:
    return f"date_add(trunc(CAST({column} AS DATE), 'week'), 5)"


def hosp(spark: SparkSession, folder: str) -> DataFrame:
    """Rates by network, week, age group, region and rate type."""
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_suppkey",
        "CASE l_returnflag WHEN 'A' THEN 'COVID-NET' WHEN 'N' THEN 'FluSurv-NET' WHEN 'R' THEN 'RSV-NET' END "
        "AS surveillance_network",
        f"{_saturday('l_shipdate')} AS week_ending_date",
        "CASE l_linenumber % 4 WHEN 0 THEN '0-17' WHEN 1 THEN '18-64' WHEN 2 THEN '65+' ELSE 'Overall' END "
        "AS age_group",
        "IF(l_linestatus = 'F', 'Observed', 'Estimated') AS rate_type",
        "l_quantity",
    )
    # One table at a time, so that each joined side has a known size of its own.
    weekly = (
        lines.join(table(spark, folder, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(table(spark, folder, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
        .withColumnRenamed("r_name", "site")
        .groupBy("surveillance_network", "week_ending_date", "age_group", "site", "rate_type")
        .agg(F.sum("l_quantity").alias("quantity"))
        .selectExpr("*", "year(week_ending_date) - IF(month(week_ending_date) < 7, 1, 0) AS start")
    )
    return weekly.selectExpr(
        "surveillance_network",
        "concat_ws('-', start, start + 1) AS season",
        "week_ending_date",
        "year(week_ending_date) AS mmwr_year",
        "weekofyear(week_ending_date) AS mmwr_week",
        "age_group",
        "'Overall' AS sex",
        "'Overall' AS race_ethnicity",
        "site",
        "quantity / 10D AS weekly_rate",
        "sum(quantity) OVER (PARTITION BY surveillance_network, start, age_group, site, rate_type "
        "ORDER BY week_ending_date) / 10D AS cumulative_rate",
        "rate_type",
    )


def ari(spark: SparkSession, folder: str) -> DataFrame:
    """Activity label by nation and week."""
    return (
        table(spark, folder, "orders")
        .selectExpr("o_custkey", "o_orderkey", f"{_saturday('o_orderdate')} AS week_end")
        .join(table(spark, folder, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, folder, "nation"), F.expr("c_nationkey = n_nationkey"))
        .groupBy("week_end", F.col("n_name").alias("geography"))
        .agg(F.max("o_orderkey").alias("newest"))
        .selectExpr(
            "week_end",
            "geography",
            "CASE newest % 7 WHEN 0 THEN 'Minimal' WHEN 1 THEN 'Very Low' WHEN 2 THEN 'Low' WHEN 3 THEN 'Moderate' "
            "WHEN 4 THEN 'High' WHEN 5 THEN 'Very High' ELSE 'Data Unavailable' END AS label",
            "CAST(newest % 7 AS STRING) AS buildnumber",
        )
    )


def pos(spark: SparkSession, folder: str) -> DataFrame:
    """Share of large values by event type and day; days stand in for weeks."""
    return (
        table(spark, folder, "events")
        .select(F.col("ts").cast("date").alias("week_end"), pathogen("event_type").alias("pathogen"), "value")
        .groupBy("week_end", "pathogen")
        .agg(F.expr("100D * count_if(value > 50) / count(*)").alias("percent_test_positivity"))
    )


def pathogen(column: str) -> Column:
    """Three event types carry the pathogen names; the others keep their own."""
    return F.expr(
        f"CASE {column} WHEN 'click' THEN 'COVID-19' WHEN 'view' THEN 'Influenza' WHEN 'purchase' THEN 'RSV' "
        f"ELSE {column} END"
    )


def ww(spark: SparkSession, folder: str) -> DataFrame:
    """One row per supplier and month, aggregated before any join."""
    monthly = (
        table(spark, folder, "lineitem")
        .selectExpr(
            "l_suppkey", "trunc(CAST(l_shipdate AS DATE), 'month') AS date_start", "l_quantity", "l_discount"
        )
        .groupBy("l_suppkey", "date_start")
        .agg(
            F.sum("l_quantity").alias("quantity"),
            F.expr("count_if(l_discount > 0.02D)").alias("detected"),
            F.count("*").alias("samples"),
        )
    )
    plants = monthly.join(table(spark, folder, "supplier"), F.expr("l_suppkey = s_suppkey")).join(
        table(spark, folder, "nation"), F.expr("s_nationkey = n_nationkey")
    )
    return plants.selectExpr(
        "n_name AS wwtp_jurisdiction",
        "CAST(l_suppkey AS STRING) AS wwtp_id",
        "concat('County_', l_suppkey % 20) AS county_names",
        "lpad(CAST(l_suppkey % 20 AS STRING), 5, '0') AS county_fips",
        "CAST(1000 * (l_suppkey + 1) AS INT) AS population_served",
        "date_start",
        "last_day(date_start) AS date_end",
        "quantity - 200D AS ptc_15d",
        "100D * detected / samples AS detect_prop_15d",
        "CAST(CAST(quantity AS BIGINT) % 101 AS DOUBLE) AS percentile",
        "'no' AS sampling_prior",
        "min(date_start) OVER (PARTITION BY l_suppkey) AS first_sample_date",
    )


def state_dim(spark: SparkSession, folder: str) -> DataFrame:
    """Geography, code and coordinates of every nation; regions are unknown to it."""
    return table(spark, folder, "nation").selectExpr(
        "n_name AS geography",
        "concat('N', n_nationkey) AS code",
        "n_nationkey + 25D AS lat",
        "n_nationkey * 2 - 120D AS lng",
    )


def labelled_places(spark: SparkSession, folder: str) -> DataFrame:
    """Activity rows by nation and, under the region's name, by region.

    The region rows are places the state dimension lacks.
    """
    nations = ari(spark, folder).select("week_end", "geography", "label")
    regions = (
        nations.join(table(spark, folder, "nation"), F.expr("geography = n_name"))
        .join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
        .groupBy("week_end", F.col("r_name").alias("geography"))
        .agg(F.max("label").alias("label"))
    )
    return nations.unionByName(regions)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question per customer, five wordings in turn."""
    return (
        table(spark, folder, "customer")
        .join(table(spark, folder, "nation"), F.expr("c_nationkey = n_nationkey"))
        .selectExpr(
            "c_custkey AS question_id",
            "CASE c_custkey % 5 WHEN 0 THEN concat('What is happening in ', n_name, '?') "
            "WHEN 1 THEN 'Current FLU positivity' WHEN 2 THEN 'Which places are the worst' "
            "WHEN 3 THEN 'Show me a summary' ELSE concat('Any outbreak near ', lower(n_name), ' today') END AS question",
        )
    )


def scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """One capacity scenario per part; missing fields take the defaults."""
    return table(spark, folder, "part").selectExpr(
        "p_partkey AS scenario_id",
        "CAST(100000 * (p_size + 1) AS BIGINT) AS population",
        "p_size / 2D AS current_rate",
        "1 + (p_partkey % 5) / 2D AS surge_multiplier",
        "CAST(10 * p_size AS BIGINT) AS beds_available",
        "CAST(p_size AS BIGINT) AS icu_beds_available",
    )


def hospitals(spark: SparkSession, folder: str) -> DataFrame:
    """One capacity scenario per supplier, for the cost and peak queries."""
    return table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS scenario_id",
        "100000 * (s_suppkey % 40 + 1) AS population",
        "(s_suppkey % 30 + 1) / 2D AS current_rate",
        "1 + (s_suppkey % 5) / 2D AS surge_multiplier",
        "10 * (s_suppkey % 40 + 1) AS beds_available",
        "s_suppkey % 40 + 1 AS icu_beds_available",
    )
