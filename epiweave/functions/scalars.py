"""Column helpers shared by the operators; all stay inside Catalyst."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from epiweave.schemas import RISK_LEVELS, UNAVAILABLE_LABEL


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def tidy(column: Column | str, places: int = 8) -> Column:
    """Round away summation-order noise and turn -0.0 into 0.0."""
    return F.round(_col(column), places) + F.lit(0.0)


def round_to(column: Column | str, places: int) -> Column:
    """Half-up rounding that does not depend on the order sums were taken in.

    A distributed average may differ in its last bits from run to run; rounding
    at 8 places first keeps a value that sits on a tie on one side of it.
    """
    return F.round(F.round(_col(column), 8), places) + F.lit(0.0)


def risk_level(label: Column | str, default: int = 1) -> Column:
    """Ordinal 0-5 of a risk label; unknown labels take ``default``."""
    label = _col(label)
    level = F.lit(default)
    for name, value in RISK_LEVELS.items():
        level = F.when(label == name, value).otherwise(level)
    return level


def percentile_band(percentile: Column | str) -> Column:
    p = _col(percentile)
    return (
        F.when(p >= 80, "Very High")
        .when(p >= 60, "High")
        .when(p >= 40, "Moderate")
        .when(p >= 20, "Low")
        .otherwise("Minimal")
    )


def banner_band(high_count: Column | str) -> Column:
    n = _col(high_count)
    return F.when(n >= 5, "danger").when(n > 0, "warning").otherwise("none")


def overall_status(high_count: Column | str) -> Column:
    return F.when(_col(high_count) > 3, "elevated").otherwise("low")


def overflow_band(probability: Column | str) -> Column:
    p = _col(probability)
    return F.when(p > 50, "high").when(p > 20, "moderate").otherwise("safe")


def marker_size(level: Column | str) -> Column:
    level = _col(level)
    return F.when(level == 0, F.lit(0.3)).otherwise(F.lit(0.4) + level * F.lit(0.15))


def trend_direction(change: Column | str) -> Column:
    """'up' for a positive change, otherwise 'down'; a missing change counts as 0."""
    return F.when(F.coalesce(_col(change), F.lit(0.0)) > 0, "up").otherwise("down")


def trend_magnitude(change: Column | str) -> Column:
    return round_to(F.abs(F.coalesce(_col(change), F.lit(0.0))), 0)


def currency_text(amount: Column | str) -> Column:
    v = _col(amount)
    return (
        F.when(v >= 1e9, F.format_string("$%.1fB", round_to(v / 1e9, 1)))
        .when(v >= 1e6, F.format_string("$%.1fM", round_to(v / 1e6, 1)))
        .when(v >= 1e3, F.format_string("$%.0fK", round_to(v / 1e3, 0)))
        .otherwise(F.format_string("$%.0f", round_to(v, 0)))
    )


def short_network(network: Column | str) -> Column:
    """'FluSurv-NET' -> 'Flu'."""
    return F.replace(F.replace(_col(network), F.lit("-NET"), F.lit("")), F.lit("Surv"), F.lit(""))


def label_slug(label: Column | str) -> Column:
    """'Very High' -> 'very-high'; only the first blank is replaced."""
    lowered = F.lower(_col(label))
    return F.coalesce(F.regexp_replace(lowered, "^([^ ]*) ", "$1-"), F.lit("low"))


def safe_name(name: Column | str) -> Column:
    """File-safe series name: 'RSV-NET' -> 'rsv_net'."""
    return F.lower(F.translate(_col(name), "- ", "__"))


def clip_zero(column: Column | str) -> Column:
    return F.greatest(_col(column), F.lit(0.0))


def season_angle(index: Column | str, period: int = 52) -> Column:
    return F.lit(2 * math.pi) * _col(index) / F.lit(period)


def add_weeks(day: Column | str, weeks: Column | int) -> Column:
    weeks = F.lit(weeks) if isinstance(weeks, int) else weeks
    return F.date_add(_col(day), weeks * 7)


def mentions(text: Column | str, words: tuple[str, ...]) -> Column:
    """True when any word occurs in the text, ignoring case, as plain substring."""
    return F.lower(_col(text)).rlike("|".join(re.escape(word) for word in words))


def is_overall_observed(overall_age: bool = True) -> Column:
    """The whole-population, observed stratum of the hospitalization table."""
    condition = (
        (F.col("sex") == "Overall") & (F.col("race_ethnicity") == "Overall") & (F.col("rate_type") == "Observed")
    )
    return condition & (F.col("age_group") == "Overall") if overall_age else condition


def is_available(label: Column | str) -> Column:
    return _col(label) != UNAVAILABLE_LABEL
