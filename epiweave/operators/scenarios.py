"""Hospital capacity scenarios: expected demand and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiweave.functions.scalars import clip_zero, overflow_band, round_to

# --- Fixed values: scenario defaults ------------------------------------------
DEFAULTS = {
    "population": 1_000_000,
    "current_rate": 5.0,
    "surge_multiplier": 2.0,
    "hospitalization_pct": 10.0,
    "icu_pct": 20.0,
    "avg_los_days": 5.0,
    "icu_los_days": 10.0,
    "beds_available": 500,
    "icu_beds_available": 50,
    "cost_per_bed_day": 3000.0,
    "cost_per_icu_day": 8000.0,
    "weeks": 8,
}


def with_defaults(scenarios: DataFrame, *extra_keys: str) -> DataFrame:
    """Every request field present: missing columns and nulls take the default."""

    def field(name: str, default) -> Column:
        given = F.col(name) if name in scenarios.columns else F.lit(None)
        kind = "double" if isinstance(default, float) else "long"
        return F.coalesce(given.cast(kind), F.lit(default).cast(kind)).alias(name)

    return scenarios.select("scenario_id", *extra_keys, *(field(n, d) for n, d in DEFAULTS.items()))


def seeded(scenarios: DataFrame, rates: DataFrame) -> DataFrame:
    """Each scenario once per network, at that network's current rate.

    The networks (three rows) are gathered into one array that every scenario
    row expands, so no join is needed.
    """
    pairs = rates.agg(F.sort_array(F.collect_list(F.struct("surveillance_network", "rate")))).scalar()
    return (
        scenarios.drop("current_rate")
        .withColumn("_seed", F.explode(pairs))
        .withColumns({"surveillance_network": F.col("_seed.surveillance_network"), "current_rate": F.col("_seed.rate")})
        .drop("_seed")
    )


def by_week(scenarios: DataFrame) -> DataFrame:
    """One row per scenario and 0-based week, with the surge ramp; none for scenarios without weeks."""
    ramp = F.lit(1.0) + (F.col("surge_multiplier") - 1) * F.least(F.lit(1.0), F.col("week") / 4)
    weeks = F.sequence(F.lit(0), F.col("weeks").cast("int") - 1)
    return scenarios.filter("weeks > 0").withColumn("week", F.explode(weeks)).withColumn("week_multiplier", ramp)


def expected_demand(scenarios: DataFrame, *extra_keys: str) -> DataFrame:
    """Expected cases to admissions to occupied beds and cost, per scenario and week; negatives clip to 0."""
    cases = F.col("current_rate") * F.col("week_multiplier") * (F.col("population") / F.lit(100_000.0))
    return (
        by_week(with_defaults(scenarios, *extra_keys))
        .withColumn("new_cases", cases)
        .withColumn("admissions", clip_zero(F.col("new_cases") * (F.col("hospitalization_pct") / 100)))
        .withColumn("icu_admissions", clip_zero(F.col("admissions") * (F.col("icu_pct") / 100)))
        .withColumn("beds", F.col("admissions") * F.least(F.col("avg_los_days") / 7, F.lit(1.5)))
        .withColumn("icu_beds", F.col("icu_admissions") * F.least(F.col("icu_los_days") / 7, F.lit(2.0)))
        .withColumn(
            "cost",
            F.col("beds") * F.col("cost_per_bed_day") * 7 + F.col("icu_beds") * F.col("cost_per_icu_day") * 7,
        )
    )


def total_cost(expected: DataFrame) -> DataFrame:
    """Expected cost of all weeks of a scenario."""
    return expected.groupBy("scenario_id").agg(round_to(F.sum("cost"), 0).alias("total_cost"))


def peaks(expected: DataFrame) -> DataFrame:
    """Highest expected weekly demand per scenario, with capacity flags and the share of weeks over capacity."""
    over = (F.col("beds") > F.col("beds_available")).cast("int")
    top = expected.groupBy("scenario_id").agg(
        round_to(F.max("beds"), 1).alias("peak_beds"),
        round_to(F.max("icu_beds"), 1).alias("peak_icu_beds"),
        F.max("beds_available").alias("_beds"),
        F.max("icu_beds_available").alias("_icu_beds"),
        round_to(F.avg(over) * 100, 1).alias("weeks_over_pct"),
    )
    return top.select(
        "scenario_id",
        "peak_beds",
        "peak_icu_beds",
        "weeks_over_pct",
        (F.col("peak_beds") > F.col("_beds")).alias("beds_exceeded"),
        (F.col("peak_icu_beds") > F.col("_icu_beds")).alias("icu_exceeded"),
        overflow_band("weeks_over_pct").alias("overflow_band"),
    )
