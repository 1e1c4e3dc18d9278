"""Question routing, answers, brief and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.operators import briefing, questions
from epiweave.plans.registry import CTES, Sources, half_up, query

_ROUTED = """
routed AS (
  SELECT question_id, geography, CASE WHEN geography IS NOT NULL THEN 'geography'
    WHEN regexp_matches(lower(question), 'covid|positivity|test|flu|rsv|influenza') THEN 'positivity'
    WHEN regexp_matches(lower(question), 'risk|high|outbreak|danger|worst|concern') THEN 'risk' ELSE 'summary' END AS route
  FROM (SELECT q.question_id, q.question, arg_min(p.geography, (-length(p.geography), p.geography)) AS geography
        FROM questions q LEFT JOIN (SELECT DISTINCT geography FROM ari) p
          ON contains(lower(q.question), lower(p.geography)) GROUP BY 1, 2)
)"""
CTES["routed"] = _ROUTED
CTES["turns"] = """
questions AS (
  SELECT CAST(conv_id * 1000 + turn AS BIGINT) AS question_id, text AS question FROM conversations
)"""


def _places(t: Sources) -> DataFrame:
    return t.ari.select("geography").distinct()


@query("route_questions", "SELECT question_id, geography, route FROM routed", "questions", "ari", "routed")
def _route_questions(t):
    return questions.route_questions(t.questions, _places(t)).select("question_id", "geography", "route")


@query("route_questions_join", "SELECT question_id, geography, route FROM routed", "questions", "ari", "routed")
def _route_questions_join(t):
    # As with more names than a pattern holds: pieces of the texts are joined with the names.
    return questions.route_questions(t.questions, _places(t), 0).select("question_id", "geography", "route")


@query(
    "route_duplicates",
    "SELECT nullif(question_id % 7, 0) AS question_id, geography, route FROM routed",
    "questions",
    "ari",
    "routed",
)
def _route_duplicates(t):
    # Ids that repeat and ids that are missing.
    asked = t.questions.withColumn("question_id", F.nullif(F.col("question_id") % 7, F.lit(0)))
    return questions.route_questions(asked, _places(t)).select("question_id", "geography", "route")


@query(
    "route_conversations",
    "SELECT question_id, geography, route FROM routed",
    "turns",
    "ari",
    "routed",
)
def _route_conversations(t):
    turns = t.table("conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question")
    )
    return questions.route_questions(turns, _places(t)).select("question_id", "geography", "route")


_BRIEF_FIELDS = f"""
SELECT (SELECT max(week_end) FROM ari) AS week_end, (SELECT count(*) FROM ari_latest) AS total_states,
  (SELECT count(*) FROM ari_latest WHERE label IN ('High', 'Very High')) AS high_count,
  (SELECT CASE WHEN count(*) > 3 THEN 'elevated' ELSE 'low' END FROM ari_latest WHERE label IN ('High', 'Very High'))
    AS status,
  coalesce((SELECT string_agg(geography, ', ' ORDER BY geography) FROM ari_latest WHERE label IN ('High', 'Very High')),
    '') AS high_risk_states,
  (SELECT pathogen FROM pos_latest ORDER BY percent_test_positivity DESC, pathogen LIMIT 1) AS dominant_pathogen,
  (SELECT {half_up("max(percent_test_positivity)", 1)} FROM pos_latest) AS dominant_positivity,
  (SELECT string_agg(pathogen || ': ' || printf('%.1f', {half_up("percent_test_positivity", 1)}) || '%', '; '
     ORDER BY pathogen) FROM pos_latest WHERE pathogen <> (SELECT pathogen FROM pos_latest
     ORDER BY percent_test_positivity DESC, pathogen LIMIT 1)) AS other_positivity,
  (SELECT string_agg(label || ': ' || n, '; ' ORDER BY level DESC) FROM (SELECT label, level, count(*) AS n
     FROM ari_latest WHERE level IS NOT NULL GROUP BY 1, 2)) AS risk_distribution"""


@query("weekly_brief", _BRIEF_FIELDS, "ari", "pos")
def _weekly_brief(t):
    return briefing.weekly_brief(t.ari, t.pos)


CTES["brief"] = f"brief AS ({_BRIEF_FIELDS})"
_POSITIVITY_TEXT = f"""(SELECT string_agg(pathogen || ': ' || printf('%.1f', {half_up("percent_test_positivity", 1)})
  || '%', '; ' ORDER BY pathogen) FROM pos_latest)"""


@query(
    "answers",
    f"""SELECT question_id, route, r.geography, CASE route
         WHEN 'geography' THEN r.geography || ' has an activity level of ' || coalesce(label, 'Unknown')
         WHEN 'positivity' THEN {_POSITIVITY_TEXT}
         WHEN 'risk' THEN (SELECT CASE WHEN high_count = 0 THEN 'No place is at a High or Very High activity level.'
           ELSE high_count || ' place(s) at a High or Very High activity level: ' || high_risk_states END FROM brief)
         ELSE (SELECT 'Week ending ' || strftime(week_end, '%Y-%m-%d') || chr(10) || 'Overall activity: ' || status ||
           ' in ' || total_states || ' places' || chr(10) || CASE WHEN high_count > 0 THEN 'High or Very High: ' ||
           high_risk_states ELSE 'High or Very High: none' END || chr(10) || 'Highest positivity: ' ||
           dominant_pathogen || ' at ' || printf('%.1f', dominant_positivity) || '%' || chr(10) ||
           'Other positivity: ' || other_positivity || chr(10) || 'Levels: ' || risk_distribution FROM brief) END AS answer
       FROM routed r LEFT JOIN ari_latest a ON r.geography = a.geography""",
    "questions",
    "ari",
    "pos",
    "routed",
    "brief",
)
def _answers(t):
    return questions.answer_questions(t.questions, t.ari, t.pos)


@query(
    "context",
    f"""SELECT (SELECT string_agg(geography || ': ' || label, '; ' ORDER BY geography) FROM ari_latest
           WHERE label <> 'Data Unavailable') AS activity,
         coalesce((SELECT string_agg(geography, ', ' ORDER BY geography) FROM ari_latest
           WHERE label IN ('High', 'Very High')), 'None') AS high_risk, {_POSITIVITY_TEXT} AS positivity,
         (SELECT string_agg(n || ': ' || printf('%.1f', {half_up("r", 1)}), '; ' ORDER BY n) FROM (
           SELECT surveillance_network AS n, avg(weekly_rate) AS r FROM overall
           WHERE week_ending_date >= (SELECT max(week_ending_date) - 28 FROM hosp) GROUP BY 1)) AS hospitalization,
         (SELECT printf('%d sites in %d counties, average percentile %.0f', count(*), count(DISTINCT county_fips),
           {half_up("avg(percentile)", 0)}) FROM ww_latest) AS wastewater""",
    "ari",
    "pos",
    "hosp",
    "ww",
)
def _context(t):
    return briefing.data_context(t.ari, t.pos, t.hosp, t.ww)
