"""The registered queries of the text operators and the SQL that must agree with them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.llm import (
    alignment,
    context_tree,
    decontamination,
    fingerprints,
    language,
    line_dedup,
    mixing,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
    variants,
)
from epiweave.llm.common import ship_package
from epiweave.sources.testdata import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# The rules of the url query, as (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# Host labels whose pages the url query lists as blocked.
LISTED_LABELS = ["spam-farm", "casino-win", "ads-track", "free-bets", "cheap-pills", "adult-x"]
#: Where the vocabulary of the token counts lies on the driver.
VOCABULARY = os.environ.get("EPIWEAVE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
#: Where the two tokenizers of the alignment lie on the driver.
BYTE_TOKENIZER = os.environ.get("EPIWEAVE_BYTE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
PIECE_TOKENIZER = os.environ.get("EPIWEAVE_PIECE_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def query(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return build(spark, folder.rstrip("/"))

        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


@registered("op1_token_counts")
def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, folder, "documents"), token_counts.load_pieces(VOCABULARY))
    return counts.select("doc_id", "n_words", "n_tokens")


@registered(
    "op2_url_filters",
    f"""
WITH rules(rule_host, rule_path, kind) AS (VALUES {", ".join(map(str, URL_RULES))}
), parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_UPPER}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), shaped AS (
  SELECT *, regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') AS canonical FROM split
), listed AS (
  SELECT DISTINCT canonical FROM shaped WHERE regexp_matches(host, '(^|[.])({"|".join(LISTED_LABELS)})[.]')
), fitting AS (
  SELECT s.*, rule_host || rule_path AS rule, kind,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
  FROM shaped s LEFT JOIN rules
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule,
       coalesce(kind, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM fitting WHERE place = 1""",
)
def _url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The pages by the rules and a list of the pages that have one of the labels in their host."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    bad = url_filter.host_of("url").rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\.")
    judged = url_filter.judge_urls(pages, rules, pages.where(bad).select("url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


@registered("op3_simhash")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@registered("op4_decontamination")
def _decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    items = table(spark, folder, "benchmark")
    judged = decontamination.contamination(docs, items)
    return judged.select("doc_id", "contaminated", "n_items")


@registered(
    "op5_line_dedup",
    f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_UPPER}) AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, pos, line, top IS NOT NULL AND doc_id <> top AS gone FROM keyed LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
)
def _line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "deduped.n_lines", "deduped.n_dropped", F.sha2("deduped.text", 256).alias("kept_sha256"))


@registered("op6_language_id")
def _language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = language.identify_languages(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return docs.select("doc_id", language.held_out().alias("held_out"), "language.lang_pred", "language.score")


@registered("op7_toxicity")
def _toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").selectExpr(
        "doc_id", "toxic", "1 - quality AS poor", "toxic * (1 - quality) AS toxic_and_poor"
    )
    docs = table(spark, folder, "documents").select("doc_id", "text")
    judged = toxicity.toxic_documents(docs, labels, ["toxic", "poor", "toxic_and_poor"])
    return judged.select(
        "doc_id",
        F.array_contains("found", "toxic").alias("toxic"),
        F.col("toxicity.toxic").alias("p_toxic"),
        F.col("toxicity.poor").alias("p_poor"),
        F.col("toxicity.toxic_and_poor").alias("p_toxic_and_poor"),
    )


@registered("op8_suffix_dedup")
def _suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256")
    )


@registered("op9_mixing")
def _mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@registered("op10_fingerprints")
def _fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, folder, "documents"))


@registered("op11_alignment")
def _alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    aligned = alignment.align(docs, BYTE_TOKENIZER, PIECE_TOKENIZER, digest=True)
    return aligned.drop("text_key").withColumnRenamed("groups", "groups_sha256")


@registered("op12_spelling_variants")
def _spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents").select("doc_id", "text"))


@registered("op13_lm_scores")
def _lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree.lm_scores(table(spark, folder, "documents").select("doc_id", "text")).drop("text_key")
