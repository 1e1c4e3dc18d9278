"""One key holding a third of the rows must not end in one task."""

import shutil

import pytest
from conftest import SMALL, rows
from pyspark.sql import functions as F

import __spark_entry__ as entry

TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")


@pytest.fixture(scope="module")
def hot_folder(spark, tmp_path_factory):
    """The test tables, eight times over, a third of the facts on one supplier and one customer."""
    folder = tmp_path_factory.mktemp("hot")
    for name in TABLES[:4]:
        shutil.copy(f"{SMALL}/{name}.parquet", folder / f"{name}.parquet")
    for name, key, unique in (("lineitem", "l_suppkey", "l_orderkey"), ("orders", "o_custkey", "o_orderkey")):
        rows_of = spark.read.parquet(f"{SMALL}/{name}.parquet").crossJoin(spark.range(8).withColumnRenamed("id", "copy"))
        hot = F.when((F.col(unique) + F.col("copy")) % 3 == 0, F.lit(0)).otherwise(F.col(key))
        spread = rows_of.withColumn(key, hot.cast("long")).drop("copy").repartition(8)
        spread.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ["hosp_trends", "risk_distribution", "ww_states", "ari_history", "anomalies_low"])
def test_same_rows_with_and_without_skew_handling(spark, hot_folder, name):
    build = entry.queries()[name]
    plain = rows(build(spark, hot_folder))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = build(spark, hot_folder)
        split = rows(df)
        if name == "hosp_trends":
            # The hot supplier's partition of the fact join is read in several pieces.
            assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert split == plain
    assert plain
