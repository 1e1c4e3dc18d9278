import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epiweave.operators import aggregates, snapshot

WEEKS = [dt.date(2024, 1, 6), dt.date(2024, 1, 13)]


def ari(spark):
    data = [(w, g, lab, "1") for w, lab in zip(WEEKS, ("Low", "High"), strict=True) for g in ("Iowa", "Ohio")]
    data.append((WEEKS[0], "Utah", "Data Unavailable", "1"))
    return spark.createDataFrame(data, "week_end date, geography string, label string, buildnumber string")


def wastewater(spark):
    data = [
        ("Ohio", "1", "Adams", "001", 100, WEEKS[1], 1.0, 50.0, 80.0),
        ("Ohio", "2", "Athens", "002", 100, WEEKS[1], -1.0, None, None),
        ("Iowa", "3", "a_b", "003", 100, WEEKS[0], 0.0, 10.0, 10.0),
    ]
    names = "wwtp_jurisdiction string, wwtp_id string, county_names string, county_fips string, population_served int, "
    return spark.createDataFrame(data, names + "date_end date, ptc_15d double, detect_prop_15d double, percentile double")


def test_latest_is_taken_before_other_filters(spark):
    assert rows(snapshot.ari_activity(ari(spark)), "geography") == [("Iowa",), ("Ohio",)]
    assert snapshot.ari_activity(ari(spark), geography="Utah").isEmpty()
    assert rows(snapshot.ari_activity(ari(spark), week_end="2024-01-06", geography="Utah"), "label") == [("Data Unavailable",)]


def test_empty_arguments_do_not_filter(spark):
    assert snapshot.ari_activity(ari(spark), week_end="", geography="").count() == 2
    assert snapshot.wastewater(wastewater(spark), state="", county="").count() == 3


def test_history_of_one_place(spark):
    assert rows(snapshot.ari_history(ari(spark), "Iowa", weeks=1), "week_end", "weeks_back") == [(WEEKS[1], 1)]
    assert snapshot.ari_history(ari(spark)).count() == 5


def test_county_fragment_is_case_sensitive_and_keeps_wildcards(spark):
    ww = wastewater(spark)
    assert rows(snapshot.wastewater(ww, county="dam"), "wwtp_id") == [("1",)]
    assert snapshot.wastewater(ww, county="ADAM").isEmpty()
    assert rows(snapshot.wastewater(ww, county="A%s"), "wwtp_id") == [("1",), ("2",)]
    assert rows(snapshot.wastewater(ww, county="a_b"), "wwtp_id") == [("3",)]
    assert rows(snapshot.wastewater(ww, state="Ohio", limit=1), "wwtp_id") == [("1",)]


def test_missing_percentiles_sort_last_and_count_as_zero(spark):
    sites = snapshot.wastewater_latest(wastewater(spark))
    assert [r.wwtp_id for r in snapshot.by_percentile(sites).collect()] == ["1", "2"]
    assert rows(snapshot.high_signal(sites), "wwtp_id") == [("1",)]
    assert aggregates.detection_average(sites).first()[0] == 25.0


def test_unknown_place_has_an_unknown_label(spark):
    asked = spark.createDataFrame([("Iowa",), ("Utah",), ("Atlantis",)], "geography string")
    assert rows(snapshot.current_label(ari(spark), asked), "geography", "label") == [
        ("Atlantis", "Unknown"),
        ("Iowa", "High"),
        ("Utah", "Unknown"),
    ]


def test_trailing_includes_both_ends(spark):
    frame = spark.range(60).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    kept = snapshot.trailing(frame, "d", 28)
    assert kept.count() == 29


@pytest.mark.parametrize("limit", [1, 7, 30, 31, 200, 5000])
def test_newest_first_against_a_full_sort(spark, limit):
    # A third of the rows fall on one date, and some dates are missing.
    day = F.when(F.col("id") % 3 == 0, F.lit(40)).otherwise((F.col("id") * 7) % 90).cast("int")
    frame = spark.range(300).select(F.date_add(F.lit("2024-01-01").cast("date"), day).alias("d"), "id")
    frame = frame.unionByName(spark.range(300, 305).select(F.lit(None).cast("date").alias("d"), "id"))
    got = [tuple(r) for r in snapshot.newest_first(frame, "d", limit, "id").collect()]
    dated = sorted((r for r in map(tuple, frame.collect()) if r[0]), key=lambda r: (-r[0].toordinal(), r[1]))
    undated = sorted((r for r in map(tuple, frame.collect()) if not r[0]), key=lambda r: r[1])
    assert got == (dated + undated)[:limit]


def test_newest_first_reads_only_the_dates_it_needs(spark, tmp_path):
    path = str(tmp_path / "by_day")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int"))
    spark.range(200).select("id", day.alias("d")).write.partitionBy("d").parquet(path)
    top = snapshot.newest_first(spark.read.parquet(path), "d", 15, "id")
    assert len(top.collect()) == 15
    files = snapshot.newest_dates(spark.read.parquet(path), "d", 15).select(F.input_file_name().alias("f"))
    assert {r.f.split("/d=")[1][:10] for r in files.distinct().collect()} == {"2024-01-19", "2024-01-20"}
    assert "PartitionFilters: [(isnull(Subquery" in top._jdf.queryExecution().executedPlan().toString()


def test_positivity_record_fills_absent_pathogens(spark):
    frame = spark.createDataFrame(
        [(WEEKS[1], "RSV", 3.0), (WEEKS[0], "COVID-19", 9.0)], "week_end date, pathogen string, percent_test_positivity double"
    )
    assert aggregates.positivity_record(frame).first().asDict() == {"covid": 0.0, "flu": 0.0, "rsv": 3.0}
    assert rows(aggregates.dominant_pathogen(frame)) == [("RSV", 3.0)]


def test_risk_share_is_capped_and_guarded(spark):
    assert rows(aggregates.risk_share(ari(spark))) == [("High", 2, 66.66666667)]
    assert aggregates.risk_share(ari(spark).filter("false")).isEmpty()


def test_state_stats(spark):
    got = {r.geography: (r.weeks, r.high_weeks, r.avg_level) for r in aggregates.state_stats(ari(spark)).collect()}
    assert got == {"Iowa": (2, 1, 3.0), "Ohio": (2, 1, 3.0), "Utah": (1, 0, 1.0)}


def test_short_series_drop_out(spark):
    data = [("RSV-NET", WEEKS[i % 2], float(i), "Overall", "Overall", "Overall", "Observed") for i in range(4)]
    frame = spark.createDataFrame(
        data,
        "surveillance_network string, week_ending_date date, weekly_rate double, age_group string, sex string, "
        "race_ethnicity string, rate_type string",
    )
    assert rows(aggregates.virus_series(frame), "date", "rate") == [(WEEKS[0], 1.0), (WEEKS[1], 2.0)]
    assert aggregates.virus_series(frame, "RSV-NET", min_points=3).isEmpty()
