import datetime as dt
import json
import random

from conftest import rows

from epiweave.plans import refresh
from epiweave.plans.dashboard import dashboard_summary
from epiweave.sources import landing, tables
from epiweave.streaming import refresh as streaming


def write_pages(folder, table, pages):
    target = folder / table
    target.mkdir(parents=True, exist_ok=True)
    for i, records in enumerate(pages):
        name = target / f"page{len(list(target.iterdir()))}-{i}.json"
        name.write_text("\n".join(json.dumps(r) for r in records) + "\n")


def records(n, seed=4):
    rng = random.Random(seed)
    weeks = [str(dt.date(2024, 1, 6) + dt.timedelta(weeks=w)) for w in range(4)]
    return [
        {
            "week_end": f"{rng.choice(weeks)}T00:00:00.000",
            "pathogen": rng.choice(["COVID-19", "Influenza", "RSV"]),
            "percent_test_positivity": rng.choice(["", "bad", str(i)]) if i % 7 == 0 else str(i),
            "_seq": i,
        }
        for i in range(n)
    ]


def newest(raw):
    want = {}
    for r in sorted(raw, key=lambda r: r["_seq"]):
        try:
            want[r["week_end"][:10], r["pathogen"]] = float(r["percent_test_positivity"])
        except ValueError:
            continue
    return want


def stored(spark, root):
    return {(str(w), p): v for w, p, v in rows(tables.read_table(spark, root, "test_positivity"), "week_end", "pathogen", "percent_test_positivity")}


def run(spark, folder, root, checkpoint):
    raw = streaming.landing_stream(spark, str(folder), "test_positivity", files_per_batch=1)
    streaming.stream_upsert(raw, "test_positivity", root, checkpoint).awaitTermination()


def test_late_and_shuffled_pages_end_in_the_newest_records(spark, tmp_path):
    raw, root = records(90), str(tmp_path / "tables")
    tables.declare_tables(spark, root, ("test_positivity",))
    shuffled = raw[:]
    random.Random(9).shuffle(shuffled)
    write_pages(tmp_path / "landing", "test_positivity", [shuffled[i : i + 30] for i in (0, 30, 60)])
    run(spark, tmp_path / "landing", root, str(tmp_path / "checkpoint"))
    assert stored(spark, root) == newest(raw)
    # A correction of an old week, then nothing new.
    late = [{"week_end": "2024-01-06", "pathogen": "RSV", "percent_test_positivity": "77", "_seq": 500}]
    write_pages(tmp_path / "landing", "test_positivity", [late])
    run(spark, tmp_path / "landing", root, str(tmp_path / "checkpoint"))
    assert stored(spark, root) == newest(raw + late)
    # Replaying every page from the start changes nothing.
    run(spark, tmp_path / "landing", root, str(tmp_path / "second-checkpoint"))
    assert stored(spark, root) == newest(raw + late)


def other_tables(folder):
    write_pages(folder, "ari_activity", [[{"week_end": "2024-01-06", "geography": "Ohio", "label": "High", "_seq": 0}], [{"week_end": "2024-01-06", "geography": "Iowa", "label": "Low", "_seq": 1}]])
    write_pages(folder, "hospitalization_rates", [[{"surveillance_network": "RSV-NET", "week_ending_date": "2024-01-06", "mmwr_year": "2024", "mmwr_week": "1", "weekly_rate": "2.5", "_seq": 0}]])
    write_pages(folder, "wastewater_sites", [[{"wwtp_id": "1", "date_end": d, "county_fips": "1", "percentile": "50", "_seq": i} for i, d in enumerate(["2024-01-06", "2022-01-01"])]])


def test_full_refresh_and_failure(spark, tmp_path):
    root, folder = str(tmp_path / "tables"), tmp_path / "landing"
    tables.declare_tables(spark, root)
    raw = records(40)
    other_tables(folder)
    assert not refresh.refresh_all(spark, str(folder), root, as_of="2024-02-01")
    # The positivity folder was missing: the tables before it stay loaded, the one after it is empty.
    loaded = {r.table_name: r.row_count for r in refresh.table_counts(spark, root).collect()}
    assert loaded == {"ari_activity": 2, "hospitalization_rates": 1, "test_positivity": 0, "wastewater_sites": 0}
    write_pages(folder, "test_positivity", [raw])
    assert refresh.refresh_all(spark, str(folder), root, as_of="2024-02-01")
    loaded = {r.table_name: r.row_count for r in refresh.table_counts(spark, root).collect()}
    assert loaded == {"ari_activity": 2, "hospitalization_rates": 1, "test_positivity": len(newest(raw)), "wastewater_sites": 1}


def test_quarantine_keeps_refused_records(spark, tmp_path):
    write_pages(tmp_path, "test_positivity", [records(40)])
    cleaned = landing.clean_positivity(landing.read_landing(spark, str(tmp_path), "test_positivity"))
    refresh.quarantine(cleaned, str(tmp_path / "refused"))
    kept = spark.read.parquet(str(tmp_path / "refused"))
    assert kept.count() == landing.rejected(cleaned).count() > 0


def test_streamed_summary_equals_the_batch_summary(spark, tmp_path):
    root, folder = str(tmp_path / "tables"), tmp_path / "landing"
    tables.declare_tables(spark, root)
    other_tables(folder)
    for name in ("ari_activity", "hospitalization_rates", "wastewater_sites"):
        refresh.load_batch(spark, root, name, landing.read_landing(spark, str(folder), name))
    write_pages(folder, "test_positivity", [records(30)])
    raw = streaming.landing_stream(spark, str(folder), "test_positivity")
    streaming.stream_summary(raw, "test_positivity", root, str(tmp_path / "checkpoint")).awaitTermination()
    streamed = streaming.read_summary(spark, root).collect()
    batch = dashboard_summary(*(tables.read_table(spark, root, n) for n in ("ari_activity", "hospitalization_rates", "test_positivity", "wastewater_sites")))
    assert streamed == batch.collect()
    assert streamed[0].total_states_tracked == 2
    streaming.refresh_summary(spark, root)
    assert streaming.read_summary(spark, root).collect() == streamed


def test_all_tables_as_streams_replace_wastewater(spark, tmp_path):
    root, folder, checkpoints = str(tmp_path / "tables"), tmp_path / "landing", str(tmp_path / "checkpoints")
    tables.declare_tables(spark, root)
    other_tables(folder)
    write_pages(folder, "test_positivity", [records(30)])

    def run_all():
        for query in streaming.stream_all(spark, str(folder), root, checkpoints):
            query.awaitTermination()
        return {r.table_name: r.row_count for r in refresh.table_counts(spark, root).collect()}

    want = {"ari_activity": 2, "hospitalization_rates": 1, "test_positivity": len(newest(records(30))), "wastewater_sites": 2}
    assert run_all() == want
    site = {"wwtp_id": "2", "date_end": "2024-01-13", "county_fips": "1", "percentile": "50", "_seq": 9}
    write_pages(folder, "wastewater_sites", [[site]])
    assert run_all() == want | {"wastewater_sites": 1}
