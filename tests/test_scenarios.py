import pytest
from conftest import rows

from epiweave.operators import scenarios as capacity

BASE = dict(capacity.DEFAULTS)


def one(spark, **given):
    names = ["scenario_id", *given]
    return spark.createDataFrame([(1, *given.values())], names)


def expected(week, **given):
    p = {**BASE, **given}
    cases = p["current_rate"] * (1 + (p["surge_multiplier"] - 1) * min(1, week / 4)) * p["population"] / 100_000
    admissions = cases * p["hospitalization_pct"] / 100
    icu = admissions * p["icu_pct"] / 100
    beds = admissions * min(p["avg_los_days"] / 7, 1.5)
    icu_beds = icu * min(p["icu_los_days"] / 7, 2.0)
    cost = beds * p["cost_per_bed_day"] * 7 + icu_beds * p["cost_per_icu_day"] * 7
    return beds, icu_beds, cost


def test_defaults_fill_missing_columns_and_nulls(spark):
    frame = spark.createDataFrame([(1, None), (2, 7.0)], "scenario_id int, current_rate double")
    got = {r.scenario_id: r.asDict() for r in capacity.with_defaults(frame).collect()}
    assert {k: v for k, v in got[1].items() if k != "scenario_id"} == BASE
    assert got[2]["current_rate"] == 7.0


@pytest.mark.parametrize("given", [{}, {"avg_los_days": 20.0, "icu_los_days": 30.0}, {"surge_multiplier": 1.0, "weeks": 3}])
def test_expected_demand(spark, given):
    got = capacity.expected_demand(one(spark, **given)).orderBy("week").collect()
    assert len(got) == given.get("weeks", 8)
    for row in got:
        assert (row.beds, row.icu_beds, row.cost) == pytest.approx(expected(row.week, **given))


def test_no_weeks_give_no_rows(spark):
    frame = spark.createDataFrame([(1, 0), (2, 1), (3, 8)], "scenario_id int, weeks int")
    got = rows(capacity.expected_demand(frame), "scenario_id", "week")
    assert got == [(2, 0), *((3, w) for w in range(8))]


def test_total_cost_is_the_sum_of_the_weeks(spark):
    frame = spark.createDataFrame([(1, 3), (2, 8)], "scenario_id int, weeks int")
    got = dict(rows(capacity.total_cost(capacity.expected_demand(frame))))
    for scenario, weeks in ((1, 3), (2, 8)):
        assert got[scenario] == pytest.approx(sum(expected(w)[2] for w in range(weeks)), abs=0.51)


def test_peaks(spark):
    frame = one(spark, beds_available=10, icu_beds_available=2000)
    row = capacity.peaks(capacity.expected_demand(frame)).first()
    beds = [expected(w)[0] for w in range(8)]
    assert row.peak_beds == pytest.approx(max(beds), abs=0.051)
    over = sum(b > 10 for b in beds) / 8 * 100
    assert (row.beds_exceeded, row.icu_exceeded) == (max(beds) > 10, False)
    assert row.weeks_over_pct == pytest.approx(over, abs=0.051)
    assert row.overflow_band == ("high" if over > 50 else "moderate" if over > 20 else "safe")


def test_seeded_by_network(spark):
    rates = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "surveillance_network string, rate double")
    seeded = capacity.seeded(capacity.with_defaults(one(spark, weeks=1)), rates)
    got = rows(capacity.expected_demand(seeded, "surveillance_network"), "surveillance_network", "beds")
    assert got == [("A", pytest.approx(expected(0, current_rate=1.0)[0])), ("B", pytest.approx(expected(0, current_rate=2.0)[0]))]
