import datetime as dt

import pytest
from conftest import rows
from test_series import series, wave, week

from epiweave.operators import forecasting
from epiweave.schemas import TABLES


@pytest.fixture(scope="module")
def panel(spark):
    return series(spark, a=wave(80), b=wave(60, 3), short=wave(29)).cache()


@pytest.fixture(scope="module")
def trained(panel):
    return forecasting.train_recursive(panel, max_iter=5)


@pytest.fixture(scope="module")
def both(panel, trained):
    return forecasting.gbt_forecast(panel, trained).cache(), forecasting.direct_forecast(panel).cache()


def check_shape(forecast, ends):
    got = forecast.collect()
    assert sorted({r.virus for r in got}) == sorted(ends)
    for virus, last in ends.items():
        mine = sorted((r for r in got if r.virus == virus), key=lambda r: r.target_date)
        assert [r.target_date for r in mine] == [last + dt.timedelta(weeks=k) for k in (1, 2, 3, 4)]
        assert all(0 <= r.lower_bound <= r.predicted_rate <= r.upper_bound for r in mine)
        widths = [r.upper_bound - r.predicted_rate for r in mine]
        assert widths == sorted(widths)
    assert forecast.columns == TABLES["forecasts"].schema.names


def test_four_weeks_with_growing_bounds(both):
    for forecast in both:
        check_shape(forecast, {"a": week(79), "b": week(59)})


def test_predictions_stay_near_the_wave(both):
    for forecast in both:
        assert all(2 < r.predicted_rate < 12 for r in forecast.collect())


def test_holdout_counts(trained):
    got = {r.virus: (r.train_samples, r.val_samples) for r in trained.metrics.collect()}
    # 71 and 51 samples, four fifths of them for training.
    assert got == {"a": (56, 15), "b": (40, 11)}
    assert all(r.mae >= 0 for r in trained.metrics.collect())


def test_importances_are_sorted_and_sum_to_one(spark, trained):
    weights = [r.importance for r in forecasting.importances(trained.model, spark).collect()]
    assert len(weights) == 10
    assert weights == sorted(weights, reverse=True)
    assert sum(weights) == pytest.approx(1.0)


def test_compare_and_stack(panel, both):
    compared = forecasting.compare_forecasts(*both)
    assert compared.count() == 8
    assert compared.filter("gbt_predicted_rate IS NULL OR direct_predicted_rate IS NULL").isEmpty()
    one_sided = forecasting.compare_forecasts(both[0].filter("virus = 'a'"), both[1])
    assert one_sided.filter("gbt_predicted_rate IS NULL").count() == 4
    stacked = forecasting.stacked(panel, *both).groupBy("source").count()
    assert rows(stacked) == [("actual", 24), ("direct", 8), ("gbt", 8)]


def test_fit_or_load(spark, panel, tmp_path):
    path = str(tmp_path / "model")
    assert forecasting.load(spark, path) is None
    first = forecasting.fit_or_load(panel, path, max_iter=2)
    again = forecasting.fit_or_load(panel, path, max_iter=50)
    assert again.model.stages[-1].getNumTrees == first.model.stages[-1].getNumTrees == 2
    a, b = (rows(forecasting.gbt_forecast(panel, t)) for t in (first, again))
    assert a == b
    direct_path = str(tmp_path / "direct")
    stored, loaded = (forecasting.fit_or_load(panel, direct_path, forecasting.train_direct) for _ in range(2))
    assert rows(forecasting.direct_forecast(panel, stored)) == rows(forecasting.direct_forecast(panel, loaded))
    retrained = forecasting.fit_or_load(panel, path, max_iter=3, retrain=True)
    assert retrained.model.stages[-1].getNumTrees == 3


def test_too_short_series_give_no_forecast(spark, trained):
    tiny = series(spark, tiny=wave(20))
    for forecast in (
        forecasting.gbt_forecast(tiny, trained),
        forecasting.gbt_forecast(tiny),
        forecasting.direct_forecast(tiny),
    ):
        assert forecast.isEmpty()
        assert forecast.columns == TABLES["forecasts"].schema.names


def test_tree_option_of_the_direct_forecast(spark):
    frame = series(spark, a=wave(60))
    direct = forecasting.train_direct(frame, kind="gbt", max_iter=2)
    check_shape(forecasting.direct_forecast(frame, direct), {"a": week(59)})
