"""Routing a table of plain-text questions to data-backed answers."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiweave.functions.scalars import mentions
from epiweave.operators.aggregates import high_risk_list
from epiweave.operators.briefing import brief_text, positivity_lines
from epiweave.operators.snapshot import place_labels
from epiweave.session import materialise
from epiweave.sources.tables import keep_last

# --- Fixed values: words that select a route, in order of precedence ----------
POSITIVITY_WORDS = ("covid", "positivity", "test", "flu", "rsv", "influenza")
RISK_WORDS = ("risk", "high", "outbreak", "danger", "worst", "concern")

#: Names up to which the place dictionary is one pattern in the plan.
PATTERN_NAMES = 10_000
#: Characters of a text that are cut into pieces at a time where it is not.
BLOCK = 256


def trie_pattern(names: Iterable[str]) -> str:
    """A regular expression of the longest name that starts at a place, as a trie.

    Names share the nodes of their common beginnings, so that a place of a text is compared with at most
    one branch per letter, whatever the number of names.
    """
    root: dict = {}
    for name in names:
        node = root
        for letter in name:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        # Nodes without a branch are walked in a loop: long names do not nest.
        before = ""
        while len(node) == 1 and "" not in node:
            ((letter, node),) = node.items()
            before += re.escape(letter)
        if node.keys() == {""}:
            return before
        further = "|".join(re.escape(c) + pattern(n) for c, n in node.items() if c)
        return f"{before}(?:{further}){'?' if '' in node else ''}"

    return pattern(root) if root else "(?!)"


def match_geography(questions: DataFrame, places: DataFrame, pattern_names: int = PATTERN_NAMES) -> DataFrame:
    """Adds the columns of the longest place named in the question, ignoring case.

    ``places`` has one row per geography and may carry further columns. Equally
    long matches resolve alphabetically, ignoring case; without a match the columns are null. Empty names match nothing.
    Up to ``pattern_names`` names are one trie in an expression over the text, which reads
    each text once where it lies; only the places are joined. More names are found by joining
    pieces of the texts, keyed by a hash of the text.
    """
    named = materialise(
        keep_last(places.withColumn("_piece", F.lower("geography")).filter("_piece <> ''"), ["_piece"], F.col("geography"))
    )
    names = [r._piece for r in named.select("_piece").limit(pattern_names + 1).collect()]
    asked = questions.withColumn("_text", F.lower("question"))
    if len(names) <= pattern_names:
        hits = F.regexp_extract_all("_text", F.lit(f"(?=({trie_pattern(sorted(names))}))"), F.lit(1))
        longest = F.aggregate(hits, F.lit(""), lambda best, x: F.when(_before(x, best), x).otherwise(best))
        found = asked.withColumn("_piece", longest)
    else:
        asked = asked.withColumn("_key", F.sha2("_text", 256))
        found = asked.join(_longest_piece(asked, named), "_key", "left").drop("_key")
    return found.join(named, "_piece", "left").select(*questions.columns, *places.columns)


def _before(x: Column, y: Column) -> Column:
    """Whether x is longer than y or as long and alphabetically before it."""
    return (F.length(x) > F.length(y)) | ((F.length(x) == F.length(y)) & (x < y))


def _longest_piece(asked: DataFrame, named: DataFrame) -> DataFrame:
    """(_key, _piece) of the texts that hold a name, by equality with pieces of the names' lengths.

    Texts are cut into blocks that overlap by the longest name, then into pieces, so a long text takes
    time in proportion to its length. Rows hold a hash of the text and a piece; those that equal a name are few.
    """
    lengths = named.agg(F.sort_array(F.collect_set(F.length("_piece")))).scalar()
    longest = named.agg(F.max(F.length("_piece"))).first()[0]
    blocks = F.regexp_extract_all("_text", F.lit(rf"(?s)(?=(.{{1,{BLOCK + longest - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    cut = asked.select("_key", F.explode(blocks).alias("block")).withColumn("size", F.explode(lengths))
    starts = F.sequence(F.lit(1), F.length("block") - F.col("size") + 1)
    pieces = F.array_distinct(F.transform(starts, lambda p: F.substring(F.col("block"), p, F.col("size"))))
    exploded = cut.filter("size <= length(block)").select("_key", F.explode(pieces).alias("_piece"))
    found = exploded.join(named.select("_piece").hint("shuffle_hash"), "_piece")
    return found.groupBy("_key").agg(F.min(F.struct((-F.length("_piece")).alias("order"), "_piece")).alias("top")).select(
        "_key", "top._piece"
    )


def route_questions(questions: DataFrame, places: DataFrame, pattern_names: int = PATTERN_NAMES) -> DataFrame:
    """Route of each question: geography, positivity, risk or summary."""
    route = (
        F.when(F.col("geography").isNotNull(), "geography")
        .when(mentions("question", POSITIVITY_WORDS), "positivity")
        .when(mentions("question", RISK_WORDS), "risk")
        .otherwise("summary")
    )
    return match_geography(questions, places, pattern_names).withColumn("route", route)


def answer_questions(questions: DataFrame, ari: DataFrame, pos: DataFrame) -> DataFrame:
    """One answer text per question, from the latest snapshots.

    The label of a place travels with its name; the other answers are scalar subqueries.
    """
    routed = route_questions(questions, place_labels(ari))
    high = high_risk_list(ari).select(
        F.when(F.size("high_risk_states") == 0, F.lit("No place is at a High or Very High activity level."))
        .otherwise(
            F.concat(
                F.size("high_risk_states").cast("string"),
                F.lit(" place(s) at a High or Very High activity level: "),
                F.concat_ws(", ", "high_risk_states"),
            )
        )
        .alias("text")
    )
    answer = (
        F.when(
            F.col("route") == "geography",
            F.concat_ws(" ", "geography", F.lit("has an activity level of"), "label"),
        )
        .when(F.col("route") == "positivity", positivity_lines(pos).scalar())
        .when(F.col("route") == "risk", high.scalar())
        .otherwise(brief_text(ari, pos).scalar())
    )
    return routed.select("question_id", "route", "geography", answer.alias("answer"))
