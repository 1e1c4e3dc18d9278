"""Z-score anomalies of the latest rate of each site and network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epiweave.functions.scalars import is_overall_observed, round_to

# --- Fixed value: site, network, |z|, direction, latest rate, mean rate -------
DESCRIPTION = "%s %s rate is %.1fσ %s average (%.1f vs avg %.1f)"


def detect_anomalies(
    hosp: DataFrame,
    top: int,
    min_points: int = 8,
    z_min: float = 2.0,
    z_crit: float = 3.0,
    recent_weeks: int = 104,
) -> DataFrame:
    """The ``top`` strongest deviations of a latest rate from the earlier mean and population deviation.

    The base is the newest ``recent_weeks`` rows of every series, however many series there are.
    """
    rows = hosp.filter(is_overall_observed()).select(
        "site", "surveillance_network", "week_ending_date", "weekly_rate"
    )
    series = ["site", "surveillance_network"]
    newest = Window.partitionBy(*series).orderBy(F.col("week_ending_date").desc())
    ranked = rows.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= recent_weeks)

    earlier, last = F.col("back") > 1, F.col("back") == 1
    stats = ranked.groupBy(*series).agg(
        F.count("*").alias("points"),
        F.max(F.when(last, F.col("week_ending_date"))).alias("detected_date"),
        F.max(F.when(last, F.col("weekly_rate"))).alias("latest"),
        F.avg(F.when(earlier, F.col("weekly_rate"))).alias("mean"),
        F.stddev_pop(F.when(earlier, F.col("weekly_rate"))).alias("std"),
    )
    z = F.col("z")
    return (
        stats.filter(F.col("points") >= min_points)
        .withColumn("z", (F.col("latest") - F.col("mean")) / (F.col("std") + F.lit(1e-8)))
        .filter(F.abs(z) > z_min)
        .select(
            "detected_date",
            F.col("site").alias("geography"),
            F.col("surveillance_network").alias("metric"),
            round_to("latest", 2).alias("value"),
            round_to(z, 2).alias("z_score"),
            F.when(F.abs(z) > z_crit, "Critical").otherwise("Warning").alias("severity"),
            F.format_string(
                DESCRIPTION,
                "site",
                F.replace("surveillance_network", F.lit("-NET"), F.lit("")),
                round_to(F.abs(z), 1),
                F.when(z > 0, "above").otherwise("below"),
                round_to("latest", 1),
                round_to("mean", 1),
            ).alias("description"),
        )
        .orderBy(F.abs("z_score").desc(), "geography", "metric")
        .limit(top)
    )
