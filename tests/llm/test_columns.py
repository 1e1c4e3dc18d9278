"""Extra columns whose names clash with those the operators work with."""

import corpus_pipeline
import pytest

from epiweave.llm import decontamination, language, line_dedup, mixing, simhash, suffix_dedup, toxicity

EXTRA = ["_doc_id", "_text_key", "_bitmap", "_ranges", "_key", "_source", "_language", "language", "copies", "toxicity"]
EXTRA += ["deduped", "cut", "text_key", "key", "fp", "pos", "h1", "n", "label", "component_id", "chunk", "hash", "tokens"]
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


@pytest.fixture
def docs(spark):
    words = ["der wald und die see", "the forest and the sea", "", None, PASSAGE, "a line of some length\nx", "the forest and the sea"]
    rows = [(i, t, "de" if i % 2 else "en", f"s{i % 3}", *(f"{c}-{i}" for c in EXTRA)) for i, t in enumerate(words)]
    rows += [(None, "null id", None, None, *([None] * len(EXTRA)))] * 2
    columns = ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {columns}")


def items(spark):
    return spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(0, 0), (1, 1), (4, 0)], "doc_id long, toxic int")


CASES = {
    "lines": (lambda s, d: line_dedup.dedup_lines(d), {"deduped"}),
    "suffixes": (lambda s, d: suffix_dedup.remove_repeats(d), {"cut"}),
    "near copies": (lambda s, d: simhash.one_of_each_group(d), set()),
    "mixing": (lambda s, d: mixing.mixed_documents(d), {"copies"}),
    "languages": (lambda s, d: language.identify_languages(d), {"language"}),
    "identified": (lambda s, d: language.identified_documents(d), set()),
    "toxicity": (lambda s, d: toxicity.toxicity(d, labels(s), ["toxic"]), {"toxicity"}),
    "benchmark": (lambda s, d: decontamination.clean_documents(d, items(s)), set()),
}


@pytest.mark.parametrize("case", CASES)
def test_every_other_column_stays(spark, docs, case):
    apply, replaced = CASES[case]
    got = apply(spark, docs)
    assert sorted(got.columns) == sorted({*docs.columns, *replaced})
    found = got.collect()
    assert found
    for row in found:
        if row.doc_id is not None:
            assert all(row[c] == f"{c}-{row.doc_id}" for c in EXTRA if c not in replaced)


def test_pipeline_stages(spark, docs):
    folder = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns or name == "mixing"
        docs = spark.createDataFrame(after.collect(), after.schema)
        if name == "decontamination":
            assert {r.doc_id for r in docs.collect()} == {0, 1, 4, 5, None}
    assert {r.doc_id for r in docs.collect()} >= {0, 1}


def test_pipeline_stages_of_no_documents(spark, docs):
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.collect() == []


def test_large_ids_beside_missing_ones(spark):
    big = 2**60 + 1
    rows = [(big, f"before {PASSAGE} after"), (None, "nothing here"), (big + 1, "clean text"), (None, PASSAGE)]
    given = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {(r.doc_id, r.contaminated) for r in decontamination.contamination(given, items(spark)).collect()}
    assert found == {(big, True), (None, False), (big + 1, False), (None, True)}
    kept = decontamination.clean_documents(given, items(spark)).collect()
    assert {r.text for r in kept} == {"nothing here", "clean text"}


def test_documents_without_words_are_not_taken(spark):
    given = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, " ")], "doc_id long, text string").selectExpr("*", "'s' AS source")
    assert {r.doc_id for r in mixing.mixed_documents(given).collect()} == {1}
