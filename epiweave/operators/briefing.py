"""Weekly brief and data context as one-row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiweave.functions.scalars import is_available, overall_status, round_to
from epiweave.operators.aggregates import (
    high_risk_list,
    risk_distribution,
    trailing_rates,
    wastewater_summary,
)
from epiweave.operators.snapshot import latest
from epiweave.schemas import HIGH_LABELS, RISK_LEVELS


def _joined(df: DataFrame, order: list[Column], text: Column, separator: str) -> DataFrame:
    """All rows of a small frame as one text, in the given order."""
    entry = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), text.alias("text"))
    lines = F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"])
    return df.agg(F.concat_ws(separator, lines).alias("text"))


def one_place(column: Column | str) -> Column:
    return F.format_string("%.1f", round_to(column, 1))


def positivity_lines(pos: DataFrame) -> DataFrame:
    """Latest positivity of every pathogen: 'RSV: 3.1%; …'."""
    text = F.concat("pathogen", F.lit(": "), one_place("percent_test_positivity"), F.lit("%"))
    return _joined(latest(pos, "week_end"), [F.col("pathogen")], text, "; ")


def distribution_lines(ari: DataFrame) -> DataFrame:
    """Label counts from Very High down to Minimal; other labels are left out."""
    severity = F.lit(None).cast("int")
    for label, level in RISK_LEVELS.items():
        severity = F.when(F.col("label") == label, -level).otherwise(severity)
    counted = risk_distribution(ari).filter(F.col("label").isin(*RISK_LEVELS))
    return _joined(counted, [severity], F.concat("label", F.lit(": "), F.col("count").cast("string")), "; ")


def weekly_brief(ari: DataFrame, pos: DataFrame) -> DataFrame:
    """The brief's fields in one row.

    Each snapshot is aggregated into one struct, read as a scalar subquery; the
    lists in it are bounded by the number of places and pathogens.
    """
    spark = ari.sparkSession
    is_high = F.col("label").isin(*HIGH_LABELS)
    activity = latest(ari, "week_end").agg(
        F.struct(
            F.max("week_end").alias("week_end"),
            F.count("*").alias("total"),
            F.count_if(is_high).alias("high"),
            F.sort_array(F.collect_list(F.when(is_high, F.col("geography")))).alias("places"),
        )
    )
    percent = F.col("percent_test_positivity")
    ranked = latest(pos, "week_end").agg(
        F.sort_array(F.collect_list(F.struct((-percent).alias("order"), "pathogen", percent.alias("percent"))))
    )

    def line(entry: Column) -> Column:
        return F.concat(entry["pathogen"], F.lit(": "), one_place(entry["percent"]), F.lit("%"))

    row = spark.range(1).select(
        activity.scalar().alias("a"),
        ranked.scalar().alias("p"),
        distribution_lines(ari).scalar().alias("risk_distribution"),
    )
    top = F.get("p", F.lit(0))
    others = F.transform(F.slice(F.col("p"), F.lit(2), F.greatest(F.size("p"), F.lit(1))), lambda e: F.struct(e["pathogen"], line(e).alias("line")))
    return row.select(
        "a.week_end",
        F.col("a.total").alias("total_states"),
        F.col("a.high").alias("high_count"),
        overall_status("a.high").alias("status"),
        F.concat_ws(", ", "a.places").alias("high_risk_states"),
        top["pathogen"].alias("dominant_pathogen"),
        round_to(top["percent"], 1).alias("dominant_positivity"),
        F.concat_ws("; ", F.transform(F.sort_array(others), lambda e: e["line"])).alias("other_positivity"),
        "risk_distribution",
    )


def brief_text(ari: DataFrame, pos: DataFrame) -> DataFrame:
    """The brief as plain text, one row."""
    b = weekly_brief(ari, pos)
    return b.select(
        F.concat_ws(
            "\n",
            F.concat(F.lit("Week ending "), F.date_format("week_end", "yyyy-MM-dd")),
            F.concat(
                F.lit("Overall activity: "),
                F.col("status"),
                F.lit(" in "),
                F.col("total_states").cast("string"),
                F.lit(" places"),
            ),
            F.when(
                F.col("high_count") > 0, F.concat(F.lit("High or Very High: "), F.col("high_risk_states"))
            ).otherwise("High or Very High: none"),
            F.concat(
                F.lit("Highest positivity: "),
                F.col("dominant_pathogen"),
                F.lit(" at "),
                one_place("dominant_positivity"),
                F.lit("%"),
            ),
            F.concat(F.lit("Other positivity: "), F.col("other_positivity")),
            F.concat(F.lit("Levels: "), F.col("risk_distribution")),
        ).alias("brief")
    )


def data_context(ari: DataFrame, pos: DataFrame, hosp: DataFrame, ww: DataFrame | None = None) -> DataFrame:
    """The latest state of all tables as text sections, one row."""
    spark = ari.sparkSession
    current = latest(ari, "week_end")
    activity = current.filter(is_available("label"))
    activity_text = F.concat("geography", F.lit(": "), "label")
    rate_text = F.concat("surveillance_network", F.lit(": "), one_place("avg_rate"))
    if ww is None:
        wastewater = F.lit("")
    else:
        wastewater = (
            wastewater_summary(ww)
            .select(
                F.format_string(
                    "%d sites in %d counties, average percentile %.0f",
                    "readings",
                    "counties",
                    F.coalesce(round_to("avg_percentile", 0), F.lit(0.0)),
                )
            )
            .scalar()
        )
    return spark.range(1).select(
        _joined(activity, [F.col("geography")], activity_text, "; ").scalar().alias("activity"),
        high_risk_list(ari)
        .select(F.coalesce(F.nullif(F.concat_ws(", ", "high_risk_states"), F.lit("")), F.lit("None")))
        .scalar()
        .alias("high_risk"),
        positivity_lines(pos).scalar().alias("positivity"),
        _joined(trailing_rates(hosp), [F.col("surveillance_network")], rate_text, "; ")
        .scalar()
        .alias("hospitalization"),
        wastewater.alias("wastewater"),
    )
