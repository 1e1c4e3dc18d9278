import datetime as dt
import random
import time

import pytest
from conftest import rows

from epiweave.operators import briefing, questions
from epiweave.plans.dashboard import dashboard_summary

WEEK, BEFORE = dt.date(2024, 1, 13), dt.date(2024, 1, 6)


def places(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "geography string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")


def ari(spark, *records):
    return spark.createDataFrame([(w, g, lab, "1") for w, g, lab in records], "week_end date, geography string, label string, buildnumber string")


def pos(spark, *records):
    return spark.createDataFrame(records, "week_end date, pathogen string, percent_test_positivity double")


CASES = {
    "How bad is ARKANSAS now?": ("Arkansas", "geography"),
    "And kansas?": ("Kansas", "geography"),
    "Covid in New York and Iowa": ("New York", "geography"),
    "Iowa or Ohio": ("Iowa", "geography"),
    "The highway is closed": (None, "risk"),
    "any FLU around": (None, "positivity"),
    "high test rates": (None, "positivity"),
    "hello": (None, "summary"),
    "": (None, "summary"),
}


def test_routes(spark):
    names = places(spark, "Kansas", "Arkansas", "New York", "Iowa", "Ohio")
    got = questions.route_questions(asked(spark, *CASES), names)
    assert {r.question: (r.geography, r.route) for r in got.collect()} == CASES


def test_one_place_in_a_third_of_the_texts(spark):
    rng = random.Random(2)
    names = [f"Place{i}" for i in range(30)]
    texts = []
    for i in range(600):
        words = [rng.choice(names) if rng.random() < 0.3 else "word" for _ in range(6)]
        texts.append(" ".join(words + (["place1"] if i % 3 == 0 else [])))
    want = {}
    for i, text in enumerate(texts):
        hits = [n for n in names if n.lower() in text.lower()]
        want[i] = min(hits, key=lambda n: (-len(n), n)) if hits else None
    got = questions.match_geography(asked(spark, *texts), places(spark, *names))
    assert {r.question_id: r.geography for r in got.collect()} == want


def test_repeated_and_missing_ids(spark):
    given = [(1, "hello"), (1, "Ohio?"), (None, "in iowa"), (None, "in iowa"), (2, None)]
    frame = spark.createDataFrame(given, "question_id long, question string")
    got = questions.match_geography(frame, places(spark, "Ohio", "Iowa"))
    assert sorted((str(r.question_id), str(r.question), str(r.geography)) for r in got.collect()) == [
        ("1", "Ohio?", "Ohio"), ("1", "hello", "None"), ("2", "None", "None"),
        ("None", "in iowa", "Iowa"), ("None", "in iowa", "Iowa"),
    ]


def test_answers(spark):
    activity = ari(spark, (BEFORE, "Ohio", "High"), (WEEK, "Iowa", "Very High"), (BEFORE, "Utah", "Low"), (WEEK, "Maine", "Low"))
    tests = pos(spark, (WEEK, "RSV", 2.25), (WEEK, "COVID-19", 7.0), (BEFORE, "RSV", 99.0))
    got = {r.question_id: r.answer for r in questions.answer_questions(asked(spark, "iowa?", "Utah?", "flu", "worst", "hello"), activity, tests).collect()}
    assert got[0] == "Iowa has an activity level of Very High"
    assert got[1] == "Utah has an activity level of Unknown"
    assert got[2] == "COVID-19: 7.0%; RSV: 2.3%"
    assert got[3] == "1 place(s) at a High or Very High activity level: Iowa"
    assert got[4].splitlines()[0] == "Week ending 2024-01-13"
    assert "Highest positivity: COVID-19 at 7.0%" in got[4]


def test_brief_fields(spark):
    activity = ari(spark, *((WEEK, f"P{i}", "High") for i in range(3)), (WEEK, "Q", "Very High"), (WEEK, "R", "Data Unavailable"), (BEFORE, "S", "Low"))
    tests = pos(spark, (WEEK, "B", 5.0), (WEEK, "A", 5.0), (WEEK, "C", 1.0))
    row = briefing.weekly_brief(activity, tests).first()
    assert (row.total_states, row.high_count, row.status) == (5, 4, "elevated")
    assert row.high_risk_states == "P0, P1, P2, Q"
    assert (row.dominant_pathogen, row.other_positivity) == ("A", "B: 5.0%; C: 1.0%")
    assert row.risk_distribution == "Very High: 1; High: 3"


def test_brief_without_high_places(spark):
    activity = ari(spark, (WEEK, "P", "Low"))
    tests = pos(spark, (WEEK, "A", 5.0))
    assert "High or Very High: none" in briefing.brief_text(activity, tests).first().brief
    assert briefing.weekly_brief(activity, tests).first().status == "low"


def test_context_without_wastewater(spark):
    activity = ari(spark, (WEEK, "P", "Low"), (WEEK, "Q", "Data Unavailable"))
    hosp = spark.createDataFrame(
        [("RSV-NET", WEEK, 4.0), ("RSV-NET", WEEK - dt.timedelta(days=28), 2.0), ("RSV-NET", WEEK - dt.timedelta(days=29), 99.0)],
        "surveillance_network string, week_ending_date date, weekly_rate double",
    ).selectExpr("*", "'Overall' AS age_group", "'Overall' AS sex", "'Overall' AS race_ethnicity", "'Observed' AS rate_type")
    row = briefing.data_context(activity, pos(spark, (WEEK, "A", 5.0)), hosp).first()
    assert (row.activity, row.high_risk, row.hospitalization, row.wastewater) == ("P: Low", "None", "RSV-NET: 3.0", "")


def test_summary_without_wastewater(spark):
    activity = ari(spark, (WEEK, "P", "High"), (BEFORE, "Q", "High"))
    hosp = spark.createDataFrame([(WEEK,)], "week_ending_date date")
    row = dashboard_summary(activity, hosp, pos(spark, (WEEK, "A", 5.0))).first()
    assert (row.total_states_tracked, row.high_risk_states, row.wastewater_sites) == (2, 1, None)
    assert [tuple(r) for r in row.risk_distribution] == [("High", 1)]


def test_summary_of_empty_tables(spark):
    row = dashboard_summary(ari(spark, (WEEK, "P", "High")).filter("false"), spark.createDataFrame([], "week_ending_date date"), pos(spark, (WEEK, "A", 5.0)).filter("false")).first()
    assert (row.latest_ari, row.total_states_tracked, row.high_risk_states) == (None, 0, 0)
    assert row.risk_distribution == []


def test_no_rows_lost(spark):
    texts = [f"question {i}" for i in range(200)]
    got = questions.route_questions(asked(spark, *texts), places(spark, "X Y Z"))
    assert rows(got, "question_id") == [(i,) for i in range(200)]


@pytest.mark.parametrize("most", [0, 100])
def test_both_ways_find_the_same(spark, most):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice("abA .(+é") for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    names = [n for n in names if n.strip()][:50] + ["a" * 300, "\U0001f600 b"]
    texts = ["".join(rng.choice("abA .(+é\n\U0001f600") for _ in range(rng.randrange(40))) for _ in range(200)]
    texts += ["b" * 200 + "a" * 300 + "b", "", None, "\U0001f600 B"]
    got = questions.match_geography(asked(spark, *texts), places(spark, *names), most)
    for r in got.collect():
        hits = [n for n in names if r.question is not None and n.lower() in r.question.lower()]
        best = min(hits, key=lambda n: (-len(n), n.lower(), n)) if hits else None
        assert r.geography == best, r.question


@pytest.mark.parametrize("most", [0, 100])
def test_text_of_a_megabyte(spark, most):
    text = "no place here " * 75_000 + "in new york"
    start = time.monotonic()
    row = questions.match_geography(asked(spark, text, "x"), places(spark, "York", "New York", "Iowa"), most).collect()
    assert {r.question_id: r.geography for r in row} == {0: "New York", 1: None}
    assert time.monotonic() - start < 30


def test_nothing_made_from_the_texts_is_broadcast(spark):
    texts = asked(spark, *(f"question {i} in ohio" for i in range(500)))
    found = questions.match_geography(texts, places(spark, "Ohio", "Iowa"))
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    sides = [part.split("BroadcastExchange", 1)[1] for part in plan.split("\n+- == Initial Plan")[:1] if "BroadcastExchange" in part]
    assert all("question" not in side for side in sides)
    assert "Generate" not in plan and "BuildLeft" not in plan


def test_trie_shares_beginnings():
    assert questions.trie_pattern(["iowa", "idaho", "i"]) == "i(?:owa|daho)?"
    assert questions.trie_pattern([]) == "(?!)"
