"""Loads that a stream reads are written by all tasks, not by one."""

from epiweave.plans.registered import streams


def test_each_load_has_a_file_per_task(spark, tmp_path):
    events = spark.range(0, 1200, 1, 4).withColumnRenamed("id", "event_id")
    path = f"{tmp_path}/events"
    files = [len(spark.read.parquet(path).inputFiles()) for _ in streams._loads(events, path)]
    assert files == [4, 8, 12]
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == list(range(1200))
