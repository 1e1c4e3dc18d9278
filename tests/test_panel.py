"""The model per series against plain numpy, its storage and its limits."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_forecasting import check_shape
from test_series import series, wave, week

from epiweave.operators import forecasting, panel
from epiweave.operators.features import HORIZON, STEPS


def noisy(count, seed):
    rng = np.random.default_rng(seed)
    return [float(v + e) for v, e in zip(wave(count, seed % 5), rng.uniform(0, 2, count), strict=True)]


VALUES = {"RSV-NET": noisy(90, 1), "B c": noisy(60, 2), "flat": [3.0] * 40, "edge": noisy(30, 3), "short": noisy(29, 4)}


@pytest.fixture(scope="module")
def many(spark):
    return series(spark, **VALUES).cache()


@pytest.fixture(scope="module")
def models(many):
    return panel.fit_panel(many).cache()


def plain_fit(values):
    """Coefficients, held-out error, (training, held-out) samples and the next four values, by numpy."""
    rates = np.array(values)
    mean, std = rates.mean(), rates.std() + 1e-8
    norm = (rates - mean) / std

    def x(at):
        angle = 2 * math.pi * at / 52
        return [1.0, *norm[at - STEPS : at], math.sin(angle), math.cos(angle)]

    places = range(STEPS, len(norm) - HORIZON)
    X = np.array([x(at) for at in places])
    Y = np.array([norm[at : at + HORIZON] for at in places])
    cut = int(0.8 * len(X))
    ridge = panel.RIDGE * cut * np.diag([0.0] + [1.0] * (panel.TERMS - 1))
    coefficients = np.linalg.solve(X[:cut].T @ X[:cut] + ridge, X[:cut].T @ Y[:cut])
    mae = np.abs(X[cut:] @ coefficients - Y[cut:]).mean() * std
    ahead = np.maximum(np.array(x(len(norm))) @ coefficients * std + mean, 0)
    return coefficients, mae, (cut, len(X) - cut), ahead


def test_every_model_equals_the_plain_fit(many, models):
    fitted = {r.virus: r for r in models.collect()}
    assert sorted(fitted) == ["B c", "RSV-NET", "edge", "flat"]
    ahead = panel.panel_forecast(many, models).collect()
    for virus, model in fitted.items():
        coefficients, mae, counts, values = plain_fit(VALUES[virus])
        assert np.allclose(np.array(model.coefficients), coefficients, atol=1e-8)
        assert model.mae == pytest.approx(mae, abs=1e-8)
        assert (model.train_samples, model.val_samples) == counts
        mine = sorted((r for r in ahead if r.virus == virus), key=lambda r: r.target_date)
        assert [r.predicted_rate for r in mine] == pytest.approx(list(values), abs=0.00501)


def test_shape_of_the_forecast(many, models):
    ends = {"RSV-NET": week(89), "B c": week(59), "flat": week(39), "edge": week(29)}
    check_shape(panel.panel_forecast(many, models), ends)


def test_a_series_is_fitted_as_if_alone(many, models):
    alone = panel.fit_panel(many.filter("virus = 'B c'")).first()
    beside = models.filter("virus = 'B c'").first()
    assert np.allclose(np.array(alone.coefficients), np.array(beside.coefficients), atol=1e-9)


def test_own_models_are_no_worse_than_the_pooled_one(spark):
    # Two series of different behaviour: one repeats its last value, one turns it round.
    rng = np.random.default_rng(7)
    kept, turned = [5.0], [5.0]
    for _ in range(119):
        kept.append(float(0.9 * kept[-1] + 0.5 + rng.uniform(-1, 1)))
        turned.append(float(10 - 0.9 * turned[-1] + rng.uniform(-0.2, 0.2)))
    both = series(spark, kept=kept, turned=turned).cache()
    own = dict(panel.fit_panel(both).select("virus", "mae").collect())
    pooled = dict(forecasting.train_direct(both).metrics.select("virus", "mae").collect())
    assert own["turned"] < pooled["turned"]
    assert own["kept"] < 1.1 * pooled["kept"]


def test_only_new_and_named_series_are_fitted_again(spark, many, tmp_path):
    path = str(tmp_path / "models")
    first = panel.fit_or_load_panel(many.filter("virus IN ('B c', 'flat')"), path)
    assert rows(first, "virus", "safe_name") == [("B c", "b_c"), ("flat", "flat")]
    before = rows(first, "virus", "train_samples")
    longer = many.withColumn("virus", F.when(F.col("virus") == "RSV-NET", "B c").when(F.col("virus") == "edge", "B-c")).dropna()
    # A longer series of the same name: its stored model stays, the new name in the same folder is added.
    second = panel.fit_or_load_panel(longer, path)
    assert rows(second.filter("virus <> 'B-c'"), "virus", "train_samples") == before
    assert rows(second, "virus") == [("B c",), ("B-c",), ("flat",)]
    third = panel.fit_or_load_panel(longer, path, retrain=["B c"])
    assert dict(rows(third, "virus", "train_samples"))["B c"] == plain_fit(VALUES["RSV-NET"])[2][0]
    assert rows(third, "virus") == [("B c",), ("B-c",), ("flat",)]
    fourth = panel.fit_or_load_panel(many, path, retrain=True)
    assert dict(rows(fourth, "virus", "train_samples"))["B c"] == plain_fit(VALUES["B c"])[2][0]
    assert rows(fourth, "virus") == [("B c",), ("B-c",), ("RSV-NET",), ("edge",), ("flat",)]


def test_no_series_long_enough(spark, many, tmp_path):
    path = str(tmp_path / "models")
    none = panel.fit_or_load_panel(many.filter("virus = 'short'"), path)
    assert none.isEmpty()
    assert panel.panel_forecast(many, none).isEmpty()


def test_a_fit_sends_sums_not_samples(many):
    samples = panel.panel_samples(many)
    text = panel.gram(samples.filter("is_train"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in text
