import datetime as dt
import json
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from epiweave.plans import refresh
from epiweave.schemas import TABLES
from epiweave.sources import landing, tables


def raw(spark, table, *records):
    schema = TABLES[table].raw_schema
    data = [tuple(r.get(n) for n in schema.names[:-1]) + (r.get("_seq", i),) for i, r in enumerate(records)]
    return spark.createDataFrame(data, schema)


HOSP = {"surveillance_network": "RSV-NET", "week_ending_date": "2024-01-06T00:00:00.000", "site": "A"}


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("", 0.0),
        (None, 0.0),
        ("0", 0.0),
        ("1.5", 1.5),
        (" 2 ", 2.0),
        ("1_000", 1000.0),
        ("1e3", 1000.0),
        (".5", 0.5),
        ("-3.", -3.0),
        ("abc", "rejected"),
        ("1.5d", "rejected"),
        ("1__0", "rejected"),
        (" ", "rejected"),
    ],
)
def test_rates_zero_fill_or_reject(spark, text, value):
    cleaned = landing.clean_hospitalization(raw(spark, "hospitalization_rates", {**HOSP, "weekly_rate": text}))
    row = cleaned.first()
    if value == "rejected":
        assert row.reject_reason == "weekly_rate missing or unreadable"
        assert landing.accepted(cleaned).isEmpty()
    else:
        assert row.reject_reason is None
        assert row.weekly_rate == value


@pytest.mark.parametrize(("text", "value"), [(None, 0), ("27", 27), ("007", 7), ("1.0", None), ("", None)])
def test_required_integers(spark, text, value):
    row = landing.clean_hospitalization(raw(spark, "hospitalization_rates", {**HOSP, "mmwr_week": text})).first()
    assert row.mmwr_week == value
    assert (row.reject_reason is None) == (value is not None)


def test_hospitalization_defaults(spark):
    row = landing.clean_hospitalization(raw(spark, "hospitalization_rates", HOSP)).first()
    assert (row.age_group, row.sex, row.race_ethnicity) == ("Overall",) * 3
    assert (row.season, row.rate_type) == ("", "")
    assert row.week_ending_date == dt.date(2024, 1, 6)


def test_ari_needs_week_place_and_label(spark):
    good = {"week_end": "2024-01-06T00:00:00.000", "geography": "Ohio", "label": "Low"}
    frame = raw(
        spark,
        "ari_activity",
        good,
        {**good, "label": ""},
        {**good, "week_end": ""},
        {**good, "geography": None},
        {**good, "week_end": "2024"},
        {**good, "week_end": "2024-13-40"},
    )
    cleaned = landing.clean_ari(frame)
    assert rows(landing.accepted(cleaned)) == [(dt.date(2024, 1, 6), "Ohio", "Low", "", 0)]
    assert landing.rejected(cleaned).count() == 5
    assert landing.rejected(cleaned).filter("_seq = 1").first().reject_reason.startswith("label")


def test_positivity_needs_a_number(spark):
    good = {"week_end": "2024-01-06", "pathogen": "RSV", "percent_test_positivity": "3.5"}
    frame = raw(
        spark,
        "test_positivity",
        good,
        {**good, "percent_test_positivity": None},
        {**good, "percent_test_positivity": ""},
        {**good, "pathogen": ""},
    )
    assert rows(landing.accepted(landing.clean_positivity(frame))) == [(dt.date(2024, 1, 6), "RSV", 3.5, 0)]


def test_wastewater_numbers_and_dates(spark):
    good = {"wwtp_id": "7", "date_end": "2024-01-15", "population_served": "", "percentile": "80.5"}
    frame = raw(
        spark, "wastewater_sites", good, {**good, "wwtp_id": ""}, {**good, "population_served": "1.5"}, {**good, "ptc_15d": "x"}
    )
    kept = landing.accepted(landing.clean_wastewater(frame)).collect()
    assert len(kept) == 1
    assert kept[0].population_served == 0
    assert kept[0].percentile == 80.5
    assert kept[0].date_start is None
    assert kept[0].county_fips == ""


def test_recent_only_is_strict(spark):
    frame = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "d string").select(
        F.col("d").cast("date").alias("date_end")
    )
    assert rows(landing.recent_only(frame, "2024-03-31", 90)) == [(dt.date(2024, 1, 2),)]


def test_pages_concatenate_with_missing_keys(spark):
    a = spark.createDataFrame([("x", 1)], "geography string, _seq long")
    b = spark.createDataFrame([("y", "Low", 2)], "geography string, label string, _seq long")
    assert landing.concat_pages([a, b]).count() == 2


def test_landing_reads_text_and_missing_keys(spark, tmp_path):
    folder = tmp_path / "landing" / "ari_activity"
    folder.mkdir(parents=True)
    (folder / "page1.json").write_text('{"week_end": "2024-01-06", "geography": "Ohio", "label": 3, "_seq": 0}\n')
    (folder / "page2.json").write_text('{"geography": "Iowa", "_seq": 1}\n')
    got = landing.read_landing(spark, str(tmp_path / "landing"), "ari_activity")
    assert rows(got, "geography", "label", "week_end", "_seq") == [
        ("Iowa", None, None, 1),
        ("Ohio", "3", "2024-01-06", 0),
    ]


BROKEN = {
    "ari_activity": '{"week_end": "2024-01-06", "geography": "Oh',
    "hospitalization_rates": "not json",
    "test_positivity": '{"week_end": 2024-01-06}',
    "wastewater_sites": '[1, {"date_end": "2024-01-06"',
}


@pytest.mark.parametrize("name", BROKEN)
def test_malformed_lines_are_refused_with_their_text(spark, tmp_path, name):
    folder = tmp_path / "landing" / name
    folder.mkdir(parents=True)
    good = {f.name: "1" for f in TABLES[name].schema.fields} | {TABLES[name].partition: "2024-01-06", "_seq": 4}
    bad = {**good, TABLES[name].partition: "no date", "_seq": 5}
    lines = [BROKEN[name], json.dumps(good), "", json.dumps(bad)]
    (folder / "page.json").write_text("\n".join(lines))
    cleaned = landing.CLEANERS[name](landing.read_landing(spark, str(tmp_path / "landing"), name))
    assert landing.accepted(cleaned).columns == [*TABLES[name].schema.names, "_seq"]
    assert [r["_seq"] for r in landing.accepted(cleaned).collect()] == [4]
    refused = {r.reject_reason: r for r in landing.rejected(cleaned).collect()}
    unreadable = refused.pop(f"{TABLES[name].partition} missing or unreadable")
    del bad["_seq"]
    assert json.loads(unreadable.raw_record) == bad
    (broken,) = refused.values()
    assert (broken.reject_reason, broken.raw_record) == ("malformed record", BROKEN[name])


def test_refresh_keeps_malformed_lines_of_every_table(spark, tmp_path):
    root = str(tmp_path / "tables")
    tables.declare_tables(spark, root)
    for name, line in BROKEN.items():
        folder = tmp_path / "landing" / name
        folder.mkdir(parents=True)
        good = {f.name: "1" for f in TABLES[name].schema.fields} | {TABLES[name].partition: "2024-01-06", "_seq": 4}
        (folder / "page.json").write_text(line + "\n" + json.dumps(good) + "\n")
    assert refresh.refresh_all(spark, str(tmp_path / "landing"), root, as_of="2024-02-01")
    assert {r.row_count for r in refresh.table_counts(spark, root).collect()} == {1}
    for name, line in BROKEN.items():
        kept = spark.read.parquet(refresh.rejected_path(root, name))
        assert rows(kept, "reject_reason", "raw_record") == [("malformed record", line)]


def test_raw_text_is_not_made_for_accepted_rows(spark, tmp_path):
    folder = tmp_path / "landing" / "ari_activity"
    folder.mkdir(parents=True)
    (folder / "page.json").write_text("{}\n")
    cleaned = landing.clean_ari(landing.read_landing(spark, str(tmp_path / "landing"), "ari_activity"))
    assert "to_json" not in landing.accepted(cleaned)._jdf.queryExecution().executedPlan().toString()


def _python_float(text):
    try:
        return float(text)
    except ValueError:
        return None


def _python_int(text):
    try:
        value = int(text)
    except ValueError:
        return None
    return value if -(2**31) <= value < 2**31 else None


def test_number_texts_read_as_python_reads_them(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(" +-0123456789._eE") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    texts += ["inf", "-Infinity", "1e400", "0x10", "1,5", "\t7\n", "1d", "1f", "12_34.5_6e1_0"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", landing.parse_decimal(F.col("t")).alias("d"), landing.parse_integer(F.col("t")).alias("i")
    )
    got = {r.t: (r.d, r.i) for r in frame.collect()}
    assert got == {t: (_python_float(t), _python_int(t)) for t in texts}
