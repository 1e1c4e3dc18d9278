import itertools

import corpus_pipeline
import pytest
from epiweave.llm import language as G
from tests.llm import test_decontamination, test_line_dedup, test_simhash

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(documents, rows) before and after each stage, by name."""
    root, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{root}/{name}")
        after = spark.read.parquet(f"{root}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert stages[name][1].dtypes == stages[names[0]][0].dtypes


def test_language_keeps_what_is_determined(stages):
    before, after = map(rows, stages["language_id"])
    judged = rows(G.identify_languages(stages["language_id"][0]))
    wanted = {i for i, r in judged.items() if r.language.lang_pred != "und"}
    assert set(after) == wanted and all(after[i] == before[i] for i in after)


def test_lines(stages):
    before, after = map(rows, stages["line_dedup"])
    wanted = test_line_dedup.brute({i: r.text for i, r in before.items()})
    assert {i: r.text for i, r in after.items()} == {i: w[0] for i, w in wanted.items()}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near_duplicates(stages):
    before, after = map(rows, stages["simhash"])
    groups = test_simhash.brute({i: r.text for i, r in before.items()})
    assert set(after) == {component for _, component in groups.values()}


def test_benchmark(spark, stages):
    before, after = map(rows, stages["decontamination"])
    items = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    texts = {i: r.text for i, r in before.items()}
    rare = {w for t in items.values() for w in itertools.pairwise(test_decontamination.tokens(t))}
    possible = {i: t for i, t in texts.items() if rare & set(itertools.pairwise(test_decontamination.tokens(t)))}
    short = {i: t for i, t in possible.items() if len(t) < 6000}
    held = {i for i, _ in test_decontamination.brute(short, items)}
    assert held == {i for i in short if i not in after}
    assert set(texts) - set(possible) <= set(after)


def test_mix_and_run(spark, stages):
    before, after = map(rows, stages["mixing"])
    assert set(after) <= set(before) and all(1 <= r.copies <= 3 for r in after.values())
    whole = rows(corpus_pipeline.run(spark, FOLDER))
    assert whole == after


def test_odd_rows_and_no_leftovers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda spark: f"{tmp_path}/shared")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60)
    names = ["copies", "_language", "_key", "deduped", "_doc_id", "toxicity"]
    kinds = dict(docs.dtypes)
    text = "the word of a long text that is only itself "
    odd = [(None, "A text without an id, by itself.", "en"), (None, None, None), (7001, None, "en"), (7002, "", "en")]
    odd += [(7003, text * 20_000, "en"), (7004, "same words here in this row twice", "en"), (7004, "same words here in this row twice", "en")]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string")
    more = more.select(*(more[c].cast(kinds[c]) for c in more.columns))
    whole = docs.unionByName(more, allowMissingColumns=True)
    whole = whole.selectExpr("*", *(f"concat('x', '{n}') AS `{n}`" for n in names))
    whole.write.parquet(f"{tmp_path}/in/documents.parquet")
    whole.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for folder in ("in", "none"):
        spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    before = {(r.doc_id, r.text) for r in whole.collect()}
    found = corpus_pipeline.run(spark, f"{tmp_path}/in")
    rest = found.collect()
    # The mix adds copies under a name of its own, or says how many in place of a column of that name.
    assert set(whole.columns) - {"copies"} <= set(found.columns)
    assert all(r[n] == f"x{n}" for r in rest for n in names if n != "copies")
    assert {r.doc_id for r in rest} <= {i for i, _ in before}
    assert not [r for r in rest if r.doc_id in (7001, 7002)]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    tables = [p.name for p in (tmp_path / "shared").glob("pipeline-*/*")]
    assert tables == ["4-mixing", "4-mixing"]

    def broken(spark, docs, folder):
        raise ValueError("broken")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [*corpus_pipeline.STAGES[:1], ("broken", broken)])
    with pytest.raises(ValueError, match="broken"):
        corpus_pipeline.run(spark, f"{tmp_path}/in")
    assert len(list((tmp_path / "shared").glob("pipeline-*"))) == 2
