"""The weekly series behind both forecasts comes from the large tables once."""

from pyspark.sql import functions as F

from epiweave.operators import forecasting
from epiweave.plans.registered import forecasts
from epiweave.plans.registry import QUERIES, sources_of, weekly_series

FOLDER = "/root/testdata/sf0.001"


def test_both_forecasts_derive_the_series_once(spark, monkeypatch):
    weeks = weekly_series(sources_of(spark, FOLDER)).count()
    derived = spark.sparkContext.accumulator(0)

    def counted(virus):
        derived.add(1)
        return virus

    def watched(t):
        return weekly_series(t).withColumn("virus", F.udf(counted).asNondeterministic()("virus"))

    def quick(series, path, train=forecasting.train_recursive):
        return train(series, max_iter=2)

    monkeypatch.setattr(forecasts, "weekly_series", watched)
    monkeypatch.setattr(forecasting, "fit_or_load", quick)
    assert len(QUERIES["forecast_compare"](spark, FOLDER).collect()) == 12
    assert derived.value == weeks
