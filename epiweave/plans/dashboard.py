"""The dashboard summary: every headline figure in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.operators.aggregates import risk_distribution, wastewater_summary
from epiweave.operators.snapshot import latest
from epiweave.schemas import HIGH_LABELS


def dashboard_summary(
    ari: DataFrame, hosp: DataFrame, pos: DataFrame, ww: DataFrame | None = None, history: DataFrame | None = None
) -> DataFrame:
    """One row of scalar subqueries; without wastewater data its fields are null.

    Figures of one snapshot come from one subquery, so each snapshot is read once.
    Given ``history`` (all weeks of ``ari``) for the places ever tracked, the other frames
    may be cut to their newest date.
    """
    spark = ari.sparkSession
    # Negated counts sort the largest first, then by label.
    counted = F.struct((-F.col("count")).alias("order"), "label")
    risks = risk_distribution(ari).agg(
        F.transform(
            F.sort_array(F.collect_list(counted)),
            lambda e: F.struct(e["label"].alias("label"), (-e["order"]).alias("count")),
        )
    )
    positivity = latest(pos, "week_end").agg(
        F.sort_array(F.collect_list(F.struct("pathogen", "percent_test_positivity")))
    )

    kind = "struct<sites:bigint,counties:bigint,avg_percentile:double,latest_date:date,readings:bigint>"
    wastewater = F.lit(None).cast(kind) if ww is None else wastewater_summary(ww).select(F.struct("*")).scalar()

    row = spark.range(1).select(
        F.coalesce(risks.scalar(), F.array()).alias("risk_distribution"),
        ari.agg(F.max("week_end")).scalar().alias("latest_ari"),
        hosp.agg(F.max("week_ending_date")).scalar().alias("latest_hospitalization"),
        pos.agg(F.max("week_end")).scalar().alias("latest_positivity_date"),
        positivity.scalar().alias("latest_positivity"),
        (ari if history is None else history).agg(F.count_distinct("geography")).scalar().alias("total_states_tracked"),
        wastewater.alias("ww"),
    )
    return headline(row)


def headline(row: DataFrame) -> DataFrame:
    """The summary's columns from its lists and dates and the struct ``ww`` of wastewater figures."""
    high = F.filter("risk_distribution", lambda e: e["label"].isin(*HIGH_LABELS))
    return row.withColumns(
        {
            "high_risk_states": F.aggregate(high, F.lit(0).cast("long"), lambda total, e: total + e["count"]),
            "wastewater_sites": F.col("ww.sites"),
            "wastewater_counties": F.col("ww.counties"),
            "wastewater_avg_percentile": F.col("ww.avg_percentile"),
            "wastewater_latest": F.col("ww.latest_date"),
        }
    ).drop("ww")
