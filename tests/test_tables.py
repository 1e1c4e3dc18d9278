import datetime as dt
import glob
import os
import random

from conftest import rows
from pyspark.sql import functions as F

from epiweave.plans import stored as stored_reads
from epiweave.schemas import LANDING_TABLES, TABLES
from epiweave.sources import tables

WEEKS = [dt.date(2024, 1, 6), dt.date(2024, 1, 13), dt.date(2024, 1, 20)]


def positivity(spark, *records):
    return spark.createDataFrame(
        [(w, p, float(v), s) for w, p, v, s in records],
        "week_end date, pathogen string, percent_test_positivity double, _seq long",
    )


def stored(spark, root):
    return rows(tables.read_table(spark, root, "test_positivity"), "week_end", "pathogen", "percent_test_positivity")


def test_declare_is_idempotent_and_keeps_rows(spark, root):
    tables.declare_tables(spark, root)
    for name, table in TABLES.items():
        frame = tables.read_table(spark, root, name)
        assert frame.columns == table.schema.names
        assert frame.isEmpty()
    tables.upsert(spark, root, "test_positivity", positivity(spark, (WEEKS[0], "RSV", 1, 0)))
    tables.declare_tables(spark, root)
    assert len(stored(spark, root)) == 1


def test_upsert_last_write_wins(spark, root):
    tables.declare_tables(spark, root, ("test_positivity",))
    tables.upsert(
        spark, root, "test_positivity", positivity(spark, (WEEKS[0], "RSV", 1, 5), (WEEKS[0], "RSV", 2, 9), (WEEKS[0], "RSV", 3, 7))
    )
    assert stored(spark, root) == [(WEEKS[0], "RSV", 2.0)]
    # A later batch wins even with a lower sequence number.
    tables.upsert(spark, root, "test_positivity", positivity(spark, (WEEKS[0], "RSV", 4, 0), (WEEKS[1], "RSV", 5, 1)))
    assert stored(spark, root) == [(WEEKS[0], "RSV", 4.0), (WEEKS[1], "RSV", 5.0)]


def test_upsert_twice_is_the_same_as_once(spark, root):
    tables.declare_tables(spark, root, ("test_positivity",))
    batch = positivity(spark, *((w, p, i, i) for i, (w, p) in enumerate((w, p) for w in WEEKS for p in ("RSV", "Flu"))))
    tables.upsert(spark, root, "test_positivity", batch)
    once = stored(spark, root)
    tables.upsert(spark, root, "test_positivity", batch)
    assert stored(spark, root) == once


def test_upsert_leaves_other_weeks_alone(spark, root):
    tables.declare_tables(spark, root, ("test_positivity",))
    tables.upsert(spark, root, "test_positivity", positivity(spark, *((w, "RSV", 1, 0) for w in WEEKS)))
    untouched = f"{tables.table_path(root, 'test_positivity')}/week_end={WEEKS[0]}/*.parquet"
    before = {f: os.stat(f).st_mtime_ns for f in glob.glob(untouched)}
    assert before
    tables.upsert(spark, root, "test_positivity", positivity(spark, (WEEKS[2], "RSV", 9, 0)))
    assert {f: os.stat(f).st_mtime_ns for f in glob.glob(untouched)} == before
    assert stored(spark, root)[-1] == (WEEKS[2], "RSV", 9.0)


def test_upsert_by_sequence_takes_batches_in_any_order(spark, tmp_path):
    rng = random.Random(3)
    records = [(rng.choice(WEEKS), rng.choice(["RSV", "Flu"]), i, i) for i in range(60)]
    want = {}
    for week, pathogen, value, _ in records:
        want[week, pathogen] = float(value)
    for attempt in range(2):
        root = str(tmp_path / f"t{attempt}")
        tables.declare_tables(spark, root, ("test_positivity",))
        rng.shuffle(records)
        for start in range(0, 60, 20):
            tables.upsert(spark, root, "test_positivity", positivity(spark, *records[start : start + 20]), by_sequence=True)
        assert {(w, p): v for w, p, v in stored(spark, root)} == want


def test_rate_type_is_not_part_of_the_key(spark):
    schema = TABLES["hospitalization_rates"]
    base = ("RSV-NET", "2023-2024", WEEKS[0], 2024, 1, "Overall", "Overall", "Overall", "A")
    frame = spark.createDataFrame([(*base, 1.0, 1.0, "Observed", 0), (*base, 2.0, 2.0, "Estimated", 1)], tables._stored_schema(schema))
    merged = tables.merge_latest(frame.limit(0), frame, schema.key)
    assert rows(merged, "weekly_rate", "rate_type") == [(2.0, "Estimated")]


def test_keep_last_with_one_key_holding_a_third_of_the_rows(spark):
    frame = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1000).alias("k"), F.col("id").alias("_seq")
    )
    got = {r.k: r._seq for r in tables.keep_last(frame, ["k"], F.col("_seq").desc()).collect()}
    want = {}
    for i in range(30000):
        want[-1 if i % 3 == 0 else i % 1000] = i
    assert got == want


def test_snapshot_replace_and_empty_batch(spark, root):
    schema = tables._stored_schema(TABLES["wastewater_sites"])
    tables.declare_tables(spark, root, ("wastewater_sites",))

    def batch(*records):
        return spark.createDataFrame(
            [("Ohio", site, "", "", 0, None, day, 0.0, 0.0, pct, "", None, seq) for site, day, pct, seq in records], schema
        )

    first = batch(("1", WEEKS[0], 10.0, 0), ("1", WEEKS[0], 20.0, 2), ("1", WEEKS[0], 15.0, 1), ("2", WEEKS[1], 30.0, 3))
    assert tables.replace_snapshot(spark, root, "wastewater_sites", first)
    read = lambda: rows(tables.read_table(spark, root, "wastewater_sites"), "wwtp_id", "percentile")
    assert read() == [("1", 20.0), ("2", 30.0)]
    assert not tables.replace_snapshot(spark, root, "wastewater_sites", batch())
    assert read() == [("1", 20.0), ("2", 30.0)]
    assert tables.replace_snapshot(spark, root, "wastewater_sites", batch(("3", WEEKS[2], 40.0, 0)))
    assert read() == [("3", 40.0)]


def test_result_tables_replace_by_key(spark, root):
    tables.declare_tables(spark, root, ("forecasts", "anomalies"))
    forecast = spark.createDataFrame(
        [(WEEKS[0], WEEKS[1], "All", "RSV-NET", 1.0, 0.5, 1.5, "gbt")], TABLES["forecasts"].schema
    )
    tables.append_results(spark, root, "forecasts", forecast)
    tables.append_results(spark, root, "forecasts", forecast.withColumn("predicted_rate", F.lit(2.0)))
    assert rows(tables.read_table(spark, root, "forecasts"), "predicted_rate") == [(2.0,)]
    anomaly = spark.createDataFrame([(WEEKS[0], "A", "RSV-NET", 9.0, 2.5, "Warning", "text")], TABLES["anomalies"].schema)
    tables.append_results(spark, root, "anomalies", anomaly)
    assert tables.read_table(spark, root, "anomalies").count() == 1


def test_statements_and_queries_with_parameters(spark, tmp_path):
    path = str(tmp_path / "notes")
    spark.sql(f"CREATE TABLE epi_notes (geography STRING, n INT) USING parquet LOCATION '{path}'")
    try:
        tables.execute(spark, "INSERT INTO epi_notes SELECT ?, ?", ["Ohio", 3])
        tables.execute(spark, "INSERT INTO epi_notes SELECT 'Iowa', 4")
        assert rows(tables.run_query(spark, "SELECT n FROM epi_notes WHERE geography = ?", ["Ohio"])) == [(3,)]
    finally:
        spark.sql("DROP TABLE epi_notes")


def test_landing_tables_are_declared():
    assert set(LANDING_TABLES) < set(TABLES)


def test_calendar_follows_loads_and_prunes_reads(spark, tmp_path):
    root = str(tmp_path)
    tables.declare_tables(spark, root, ("ari_activity",))
    assert stored_reads.newest(spark, root, "ari_activity").count() == 0
    schema = tables._stored_schema(TABLES["ari_activity"])

    def load(rows):
        frame = [(dt.date.fromisoformat(d), place, "High", None, i) for i, (d, place) in enumerate(rows)]
        tables.upsert(spark, root, "ari_activity", spark.createDataFrame(frame, schema))

    def calendar():
        return {str(d): n for d, n in tables.read_calendar(spark, root, "ari_activity").collect()}

    load([("2024-01-06", "Ohio"), ("2024-01-13", "Ohio"), ("2024-01-13", "Iowa")])
    load([("2024-01-06", "Iowa"), ("2024-01-06", "Ohio"), ("2023-12-30", "Ohio")])
    want = {"2023-12-30": 1, "2024-01-06": 2, "2024-01-13": 2}
    assert calendar() == want
    tables.compact_calendar(spark, root, "ari_activity")
    assert calendar() == want
    newest = stored_reads.newest(spark, root, "ari_activity")
    assert {r.geography for r in newest.collect()} == {"Ohio", "Iowa"}
    assert stored_reads.newest(spark, root, "ari_activity", days=7).count() == 4
    assert stored_reads.newest_rows(spark, root, "ari_activity", 3).count() == 4
    plan = newest._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "geography" in line]
    assert scans and all("PartitionFilters: []" not in line for line in scans)


def test_forecasts_of_two_models_are_kept_side_by_side(spark, root):
    tables.declare_tables(spark, root, ("forecasts",))
    for model, rate in (("gbt", 1.0), ("direct", 2.0), ("gbt", 3.0)):
        row = (WEEKS[0], WEEKS[1], "All", "RSV-NET", rate, 0.5, 3.5, model)
        tables.append_results(spark, root, "forecasts", spark.createDataFrame([row], TABLES["forecasts"].schema))
    stored = tables.read_table(spark, root, "forecasts")
    assert rows(stored, "model_version", "predicted_rate") == [("direct", 2.0), ("gbt", 3.0)]
