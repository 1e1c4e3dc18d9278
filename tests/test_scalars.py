import pytest
from conftest import rows

from epiweave.functions import scalars as S
from epiweave.operators import lookups, snapshot
from epiweave.schemas import RISK_LEVELS, STATE_CODES, STATE_COORDINATES, network_dimension, state_dimension


def apply(spark, function, *values, kind="double"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in frame.select("i", function("x").alias("y")).orderBy("i").collect()]


def test_percentile_bands_at_their_edges(spark):
    got = apply(spark, S.percentile_band, 19.9, 20.0, 40.0, 60.0, 80.0, None)
    assert got == ["Minimal", "Low", "Moderate", "High", "Very High", "Minimal"]


def test_count_bands(spark):
    assert apply(spark, S.banner_band, 0, 1, 4, 5, kind="long") == ["none", "warning", "warning", "danger"]
    assert apply(spark, S.overall_status, 3, 4, kind="long") == ["low", "elevated"]
    assert apply(spark, S.overflow_band, 20.0, 20.1, 50.0, 50.1) == ["safe", "moderate", "moderate", "high"]


def test_risk_levels(spark):
    labels = [*RISK_LEVELS, "Data Unavailable", None]
    assert apply(spark, S.risk_level, *labels, kind="string") == [0, 1, 2, 3, 4, 5, 1, 1]
    assert apply(spark, lambda c: S.risk_level(c, 0), "Data Unavailable", kind="string") == [0]


def test_marker_size(spark):
    assert apply(spark, S.marker_size, 0, 1, 5, kind="int") == pytest.approx([0.3, 0.55, 1.15])


def test_trend(spark):
    assert apply(spark, S.trend_direction, 1.0, 0.0, -1.0, None) == ["up", "down", "down", "down"]
    assert apply(spark, S.trend_magnitude, 1.4, -2.6, None) == [1.0, 3.0, 0.0]


def test_currency(spark):
    assert apply(spark, S.currency_text, 999.0, 1000.0, 1.5e6, 2.34e9) == ["$999", "$1K", "$1.5M", "$2.3B"]


def test_names(spark):
    assert apply(spark, S.short_network, "COVID-NET", "FluSurv-NET", "RSV-NET", kind="string") == ["COVID", "Flu", "RSV"]
    assert apply(spark, S.safe_name, "FluSurv-NET", "A B-C", kind="string") == ["flusurv_net", "a_b_c"]
    assert apply(spark, S.label_slug, "Very High", "Low", None, kind="string") == ["very-high", "low", "low"]


def test_rounding_is_half_up_and_has_no_negative_zero(spark):
    assert apply(spark, lambda c: S.round_to(c, 2), 2.425, 0.1 + 0.2, -0.001) == [2.43, 0.3, 0.0]
    assert str(apply(spark, lambda c: S.tidy(c, 2), -0.001)[0]) == "0.0"


def test_mentions_is_plain_substring(spark):
    got = apply(spark, lambda c: S.mentions(c, ("high", "risk")), "The HIGHWAY is closed", "asterisk", "calm", kind="string")
    assert got == [True, True, False]


def test_dimensions(spark):
    states = state_dimension(spark)
    assert states.count() == len(STATE_CODES) == 52
    assert states.filter("lat IS NULL").count() == 52 - len(STATE_COORDINATES) == 2
    assert network_dimension(spark).count() == 3


def test_lookups_inner_left_and_reverse(spark):
    states = state_dimension(spark)
    seen = spark.createDataFrame([("Ohio", "High"), ("Atlantis", "Low"), ("Puerto Rico", "Low")], "geography string, label string")
    assert rows(lookups.with_state_code(seen, states), "geography", "code") == [("Ohio", "OH"), ("Puerto Rico", "PR")]
    named = seen.withColumnRenamed("geography", "state")
    no_territory = states.filter("code <> 'PR'")
    coded = lookups.with_code_or_name(named, no_territory)
    assert rows(coded, "state", "code") == [("Atlantis", "Atlantis"), ("Ohio", "OH"), ("Puerto Rico", "Puerto Rico")]
    assert rows(lookups.state_of_code(coded.drop("state"), states), "code", "geography") == [("OH", "Ohio")]
    assert rows(lookups.map_points(seen, states), "name", "level", "ring") == [("Ohio", 4, True)]


def test_rank_by_level_is_ordered(spark):
    frame = spark.createDataFrame(
        [("B", "High"), ("A", "High"), ("C", "Odd"), ("D", "Data Unavailable"), ("E", "Very High")],
        "geography string, label string",
    )
    assert [r.geography for r in lookups.rank_by_level(frame).collect()] == ["E", "A", "B", "C"]


def test_display_defaults(spark):
    frame = spark.createDataFrame([(None, None, None), ("", 5, 1.0)], "county string, population_served int, percentile double")
    assert rows(snapshot.with_display_defaults(frame)) == [("Unknown County", 0, 0.0), ("Unknown County", 5, 1.0)]


def test_iso_dates_and_json(spark):
    frame = spark.sql("SELECT DATE'2024-01-06' AS week_end, CAST(NULL AS DATE) AS date_end, 1 AS n")
    iso = snapshot.iso_dates(frame)
    assert rows(iso) == [("2024-01-06", None, 1)]
    assert snapshot.as_json(iso).first().value == '{"week_end":"2024-01-06","date_end":null,"n":1}'
