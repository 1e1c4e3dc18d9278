import datetime as dt

import pytest
from conftest import rows

from epiweave.plans import states
from epiweave.plans.stored import stored_summary
from epiweave.schemas import LANDING_TABLES, TABLES
from epiweave.sources import tables
from epiweave.streaming import refresh as streaming
from test_streaming import write_pages

W1, W2, W3 = (str(dt.date(2024, 1, 6) + dt.timedelta(weeks=w)) for w in range(3))


def same_as_tables(spark, root):
    merged, recomputed = states.merged_summary(spark, root).first(), stored_summary(spark, root).first()
    assert merged.asDict(recursive=True) == recomputed.asDict(recursive=True)
    return merged


def ari(spark, *records):
    kind = TABLES["ari_activity"].schema
    frame = spark.createDataFrame([(dt.date.fromisoformat(w), g, label, "1") for w, g, label in records], kind)
    return frame.selectExpr("*", "CAST(0 AS BIGINT) AS _seq")


def load(spark, root, batch):
    def record(written):
        states.write_states(root, "ari_activity", written)

    tables.upsert(spark, root, "ari_activity", batch, after_write=record)


@pytest.fixture
def declared(spark, root):
    tables.declare_tables(spark, root, LANDING_TABLES)
    states.declare_states(spark, root)
    return root


def test_batches_of_which_one_corrects_an_old_week(spark, declared):
    assert same_as_tables(spark, declared).total_states_tracked == 0
    load(spark, declared, ari(spark, (W1, "Ohio", "High"), (W1, "Utah", "Low"), (W2, "Ohio", "Low")))
    load(spark, declared, ari(spark, (W3, "Ohio", "Very High"), (W3, "Iowa", "High")))
    load(spark, declared, ari(spark, (W1, "Utah", "High"), (W1, "Maine", "Low")))
    row = same_as_tables(spark, declared)
    assert (row.total_states_tracked, row.high_risk_states, str(row.latest_ari)) == (4, 2, W3)
    load(spark, declared, ari(spark, (W3, "Iowa", "Minimal")))
    assert same_as_tables(spark, declared).high_risk_states == 1


def test_a_batch_records_the_dates_it_touched(spark, declared):
    load(spark, declared, ari(spark, (W1, "Ohio", "High"), (W2, "Ohio", "Low")))
    load(spark, declared, ari(spark, (W2, "Utah", "Low")))
    written = spark.read.parquet(states.states_path(declared, "ari_activity"))
    last = written.filter(written.version == written.agg({"version": "max"}).first()[0])
    assert [(str(d), p) for d, p in rows(last, "day", "places")] == [(W2, ["Ohio", "Utah"])]


def test_no_table_is_read(spark, declared):
    load(spark, declared, ari(spark, (W1, "Ohio", "High")))
    plan = states.merged_summary(spark, declared)._jdf.queryExecution().optimizedPlan().toString()
    assert "RelationV2" not in plan
    for name in LANDING_TABLES:
        files = states.read_states(spark, declared, name).inputFiles()
        assert files and all("/summary_states/" in f for f in files)
    assert "week_ending_date" not in plan and "geography" not in plan


def test_versions_are_put_together(spark, declared):
    for i in range(4):
        load(spark, declared, ari(spark, (W1, f"Place{i}", "High"), (W2, "Ohio", f"Level{i}")))
    before = rows(states.read_states(spark, declared, "ari_activity"))
    listed = spark.read.parquet(states.states_path(declared, "ari_activity"))  # a reader that has listed the files
    states.compact_states(spark, declared, "ari_activity", most=2)
    assert rows(states.read_states(spark, declared, "ari_activity")) == before
    assert listed.count() == 8
    for _ in range(3):
        load(spark, declared, ari(spark, (W2, "Ohio", "Last")))
    states.compact_states(spark, declared, "ari_activity", most=2)
    assert len(states._versions(spark, declared, "ari_activity")) < 8
    assert same_as_tables(spark, declared).total_states_tracked == 5


def test_streams_of_all_tables_keep_one_summary(spark, tmp_path):
    root, landing = str(tmp_path / "tables"), tmp_path / "landing"
    tables.declare_tables(spark, root, LANDING_TABLES)
    pages = [[{"week_end": W2, "pathogen": "RSV", "percent_test_positivity": "5", "_seq": 1}]]
    write_pages(landing, "test_positivity", pages)
    write_pages(landing, "ari_activity", [[{"week_end": W1, "geography": "Ohio", "label": "High", "buildnumber": "1", "_seq": 1}]])
    sites = [{"wwtp_id": str(i), "date_end": W1, "county_fips": "1", "percentile": str(10 * i), "_seq": i} for i in (1, 2, 3)]
    write_pages(landing, "wastewater_sites", [sites])
    (landing / "hospitalization_rates").mkdir()
    for running in streaming.stream_all(spark, str(landing), root, str(tmp_path / "checkpoints"), summary=True):
        running.awaitTermination()
    row = streaming.read_summary(spark, root).first()
    assert row.asDict(recursive=True) == same_as_tables(spark, root).asDict(recursive=True)
    assert (row.wastewater_sites, row.wastewater_avg_percentile, row.latest_positivity[0].pathogen) == (3, 20.0, "RSV")
    # A snapshot takes the place of all sites; a reading of an older date than before is then the newest.
    write_pages(landing, "wastewater_sites", [[sites[0] | {"date_end": "2023-12-30", "_seq": 9}]])
    running = streaming.stream_all(spark, str(landing), root, str(tmp_path / "checkpoints"), summary=True)
    for query in running:
        query.awaitTermination()
    row = streaming.read_summary(spark, root).first()
    assert (row.wastewater_sites, str(row.wastewater_latest)) == (1, "2023-12-30")
