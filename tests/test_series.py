"""Ordered operators against plain Python on small series."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows

from epiweave.operators import aggregates, anomalies, features, trends

START = dt.date(2023, 1, 7)


def week(i):
    return START + dt.timedelta(weeks=i)


def series(spark, **values):
    data = [(name, week(i), float(v)) for name, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(data, "virus string, date date, rate double")


def wave(n, seed=1):
    rng = np.random.default_rng(seed)
    return (5 + 3 * np.sin(np.arange(n) / 5) + rng.random(n)).tolist()


def hosp(spark, *records):
    """(site, network, week index, rate) as overall observed rows."""
    return spark.createDataFrame(
        [(n, "s", week(i), 2023, i, "Overall", "Overall", "Overall", s, float(r), 0.0, "Observed") for s, n, i, r in records],
        "surveillance_network string, season string, week_ending_date date, mmwr_year int, mmwr_week int, age_group string, "
        "sex string, race_ethnicity string, site string, weekly_rate double, cumulative_rate double, rate_type string",
    )


@pytest.mark.parametrize(("length", "samples"), [(8, 0), (11, 0), (12, 3), (30, 21)])
def test_tabular_samples_of_short_series(spark, length, samples):
    assert features.tabular_samples(series(spark, a=wave(length))).count() == samples


@pytest.mark.parametrize(("length", "samples"), [(15, 0), (16, 0), (17, 1), (40, 24)])
def test_sequence_samples_of_short_series(spark, length, samples):
    assert features.sequence_samples(series(spark, a=wave(length))).count() == samples


def test_tabular_features_against_pandas(spark):
    inputs = {"a": wave(30), "b": wave(25, 7)}
    got = features.tabular_samples(series(spark, **inputs)).toPandas().set_index(["virus", "idx"]).sort_index()
    for name, values in inputs.items():
        rate = pd.Series(values)
        before, angle = rate.shift(1), 2 * math.pi * rate.index.to_numpy() / 52
        want = pd.DataFrame(
            {
                **{f"lag_{k}": rate.shift(k) for k in (1, 2, 4, 8)},
                **{f"roll_avg_{k}": before.rolling(k).mean() for k in (4, 8)},
                "roll_std_4": before.rolling(4).std(ddof=0),
                "diff_1": before.diff(),
                "week_sin": np.sin(angle),
                "week_cos": np.cos(angle),
                "target": rate,
            }
        ).iloc[8:-1]
        mine = got.loc[name]
        assert list(mine.index) == list(want.index)
        np.testing.assert_allclose(mine[want.columns], want, atol=1e-9)


def test_sequence_features_against_pandas(spark):
    values = wave(24)
    for row in features.sequence_samples(series(spark, a=values)).collect():
        past = pd.Series(values[row.idx - 12 : row.idx])
        want = pd.DataFrame(
            {
                "step": past.index,
                "value": past,
                "lag1": past.shift(1).fillna(past),
                "lag2": past.shift(2).fillna(past),
                "roll_avg": past.rolling(4, min_periods=1).mean(),
                "week_sin": np.sin(2 * math.pi * (past.index + row.idx - 12) / 52),
            }
        )
        np.testing.assert_allclose([list(step) for step in row.steps], want.to_numpy(), atol=1e-9)
        assert row.targets == pytest.approx(values[row.idx : row.idx + 4])


def test_latest_window_continues_the_samples(spark):
    values = wave(20)
    row = features.latest_window(series(spark, a=values)).first()
    assert row.date == week(19)
    assert [s.value for s in row.steps] == pytest.approx(values[-12:])
    assert row.steps[0].week_sin == pytest.approx(math.sin(2 * math.pi * 8 / 52))
    assert features.latest_window(series(spark, a=wave(11))).isEmpty()


def test_normalise_and_back(spark):
    frame = series(spark, a=wave(15), flat=[3.0] * 10)
    scaled = features.normalised(frame)
    assert all(abs(r.norm) < 1e-6 for r in scaled.filter("virus = 'flat'").collect())
    back = features.denormalise(
        scaled.select("virus", "date", scaled["norm"].alias("rate")), aggregates.series_stats(frame), "rate"
    )
    assert [r[0] for r in rows(back, "rate")] == pytest.approx([r[0] for r in rows(frame, "rate")])


def test_split_keeps_time_order(spark):
    split = features.time_split(series(spark, a=wave(11), b=wave(5)))
    got = {v: [r.is_train for r in split.filter(f"virus = '{v}'").orderBy("date").collect()] for v in "ab"}
    assert got == {"a": [True] * 8 + [False] * 3, "b": [True] * 4 + [False]}


def test_recent_rates(spark):
    got = features.recent_rates(series(spark, a=[1.234, 2.0, 3.0], b=wave(20)))
    assert rows(got.filter("virus = 'a'"), "label", "rate") == [("Week -1", 3.0), ("Week -2", 2.0), ("Week -3", 1.23)]
    assert got.filter("virus = 'b'").count() == 8


def test_status_limits(spark):
    frame = series(spark, n7=wave(7), n8=wave(8), n12=wave(12), n29=wave(29), n30=wave(30))
    ok = {r.virus: [r.training == "ok", r.direct_forecast == "ok", r.recursive_forecast == "ok"] for r in features.series_status(frame).collect()}
    assert ok == {
        "n7": [False, False, False],
        "n8": [False, False, True],
        "n12": [False, True, True],
        "n29": [False, True, True],
        "n30": [True, True, True],
    }


def test_week_over_week_edges(spark):
    frame = series(spark, zero=[0, 5], one=[4], up=[8.0, 10.1])
    assert rows(trends.week_over_week(frame), "virus", "change_pct") == [("one", 0.0), ("up", 26.3), ("zero", 0.0)]


def test_seasons(spark):
    data = [("N", s, w, float(i)) for i, (s, w) in enumerate([("20-21", 1), ("21-22", 1), ("21-22", 2), ("22-23", 1)])]
    frame = spark.createDataFrame(data, "surveillance_network string, season string, mmwr_week int, avg_rate double")
    assert rows(trends.last_seasons(frame), "season", "season_rank") == [("21-22", 2), ("21-22", 2), ("22-23", 1)]
    aligned = trends.season_alignment(frame)
    assert rows(aligned, "season", "mmwr_week", "previous_rate") == [
        ("20-21", 1, None),
        ("21-22", 1, 0.0),
        ("21-22", 2, None),
        ("22-23", 1, 1.0),
    ]


def test_missing_weeks_lie_on_a_line(spark):
    frame = series(spark, a=[1, 2, 3, 4, 5]).filter("rate NOT IN (2, 3)")
    filled = trends.fill_missing_weeks(frame)
    assert rows(filled, "date", "rate", "interpolated") == [
        (week(i), pytest.approx(float(i + 1)), i in (1, 2)) for i in range(5)
    ]


def test_heatmap_grid_fills_and_cuts(spark):
    data = [("N", week(0), "0-17", 1.0), ("N", week(1), "65+", 2.0), ("N", week(2), "0-17", 3.0)]
    frame = spark.createDataFrame(data, "surveillance_network string, week_ending_date date, age_group string, rate double")
    grid = aggregates.heatmap_grid(frame, ["0-17", "65+"], weeks=2)
    assert rows(grid) == [("N", week(1), 0.0, 2.0), ("N", week(2), 3.0, 0.0)]


# --- Anomalies ----------------------------------------------------------------


def expected_anomalies(records, recent_weeks=104, z_min=2.0):
    """(site, network, z, severity) by pandas."""
    frame = pd.DataFrame(records, columns=["site", "network", "week", "rate"])
    frame = frame.sort_values(["week", "site", "network"], ascending=[False, True, True])
    frame = frame.groupby(["site", "network"]).head(recent_weeks)
    found = []
    for key, group in frame.groupby(["site", "network"]):
        if len(group) >= 8:
            latest, earlier = group.rate.iloc[0], group.rate.iloc[1:]
            score = (latest - earlier.mean()) / (earlier.std(ddof=0) + 1e-8)
            found.append((*key, round(score, 2), "Critical" if abs(score) > 3 else "Warning"))
    large = [f for f in found if abs(f[2]) > z_min]
    return sorted(large, key=lambda f: (-abs(f[2]), f[0], f[1]))[:20]


def test_anomalies_by_hand(spark):
    rng = np.random.default_rng(5)
    records = [
        (f"S{s}", net, i, round(float(10 + rng.normal() + (6 if i == 29 and s % 3 == 0 else 0)), 2))
        for s in range(12)
        for net in ("RSV-NET", "COVID-NET")
        for i in range(30 if s else 7)
    ]
    want = expected_anomalies(records)
    assert want
    frame = hosp(spark, *records)
    got = [(r.geography, r.metric, r.z_score, r.severity) for r in anomalies.detect_anomalies(frame, 20).collect()]
    assert got == want
    fewer = [(r.geography, r.metric, r.z_score, r.severity) for r in anomalies.detect_anomalies(frame, 20, recent_weeks=12).collect()]
    assert fewer == expected_anomalies(records, 12)


def test_anomalies_need_enough_points(spark):
    spike = [("A", "RSV-NET", i, 1 + (i % 2) / 10) for i in range(12)] + [("A", "RSV-NET", 12, 50)]
    filler = [("B", "RSV-NET", i, 1 + (i % 2) / 10) for i in range(12)]
    got = anomalies.detect_anomalies(hosp(spark, *spike, *filler), 20).collect()
    assert [r.geography for r in got] == ["A"]
    assert got[0].severity == "Critical"
    assert got[0].description.startswith("A RSV rate is ")
    assert got[0].description.endswith("σ above average (50.0 vs avg 1.1)")
    short = [("C", "RSV-NET", i, 1.0 if i < 6 else 99.0) for i in range(7)]
    assert anomalies.detect_anomalies(hosp(spark, *short, *filler, *filler[:1]), 20).isEmpty()


def test_constant_series_uses_the_small_floor(spark):
    flat = [("A", "RSV-NET", i, 2.0) for i in range(20)]
    assert anomalies.detect_anomalies(hosp(spark, *flat), 20).isEmpty()
    assert anomalies.detect_anomalies(hosp(spark, *flat, ("A", "RSV-NET", 20, 2.1)), 20).first().severity == "Critical"
