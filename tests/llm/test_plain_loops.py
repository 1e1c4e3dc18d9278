"""The trained operators' queries against plain loops over every byte and every word."""

import math

import pytest

from epiweave.llm import language as G
from epiweave.llm import queries
from epiweave.llm import toxicity as T

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of up to 600 characters and odd ones, with their labels."""
    out = str(tmp_path_factory.mktemp("loops"))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars <= 600").limit(150)
    odd = spark.createDataFrame(
        [(10_000_001, None), (10_000_002, ""), (10_000_003, "12 34!"), (10_000_004, "é" * 300), (10_000_004, "the cat")],
        "doc_id long, text string",
    ).selectExpr("CAST(doc_id AS " + dict(docs.dtypes)["doc_id"] + ") AS doc_id", "text")
    docs.unionByName(odd, allowMissingColumns=True).write.parquet(f"{out}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    labels.write.parquet(f"{out}/labels.parquet")
    return out


def gate(x):
    return min(1.0, max(0.0, 0.25 * x + 0.5))


def states(layer, data):
    """Hidden states after each byte, one number at a time."""
    size, out = G.HIDDEN, []
    h = [0.0] * size
    gates, new, u_gates, u_new = (p.astype(float).tolist() for p in layer.parameters())
    for byte in data:
        z = [gate(gates[byte][j] + sum(h[i] * u_gates[i][j] for i in range(size))) for j in range(size)]
        r = [gate(gates[byte][size + j] + sum(h[i] * u_gates[i][size + j] for i in range(size))) for j in range(size)]
        n = [
            max(-1.0, min(1.0, new[byte][j] + r[j] * sum(h[i] * u_new[i][j] for i in range(size)))) for j in range(size)
        ]
        h = [n[j] + z[j] * (h[j] - n[j]) for j in range(size)]
        out.append(h)
    return out


def plain_language(network, text):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data, pooled = text.encode(), [0.0] * len(network.languages)
    out, bias = network.out.astype(float).tolist(), network.bias.astype(float).tolist()
    for start in range(0, len(data), 128):
        stretch = data[start : start + 128]
        ahead, back = states(network.ahead, stretch), states(network.back, stretch[::-1])[::-1]
        for one, two in zip(ahead, back, strict=True):
            both = one + two
            score = [bias[k] + sum(both[i] * out[i][k] for i in range(len(both))) for k in range(len(bias))]
            total = sum(math.exp(s) for s in score)
            for k, s in enumerate(score):
                pooled[k] += math.exp(s) / total
    best = max(range(len(pooled)), key=lambda k: pooled[k])
    return network.languages[best], pooled[best] / sum(pooled)


def test_language_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    network = G.train(G.training_windows(docs))
    wanted = sorted((r.doc_id, *plain_language(network, r.text)) for r in docs.collect())
    found = sorted((r.doc_id, r.lang_pred, r.score) for r in queries.QUERIES["op6_language_id"](spark, folder).collect())
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted, strict=True):
        assert f[:2] == w[:2] and f[2] == pytest.approx(w[2], abs=1e-3)


def test_sample_does_not_depend_on_partitions(spark, folder, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    monkeypatch.setattr(G, "DOCS_PER_LANGUAGE", 20)
    monkeypatch.setattr(G, "PARTITIONS_AT_ONCE", 3)
    assert G.training_windows(docs.repartition(13)) == G.training_windows(docs.coalesce(1))


def plain_words(text):
    words, word = set(), ""
    for c in (text or "").lower() + " ":
        if c.isalnum() or c == "_":
            word += c
        else:
            words.add(word)
            word = ""
    return words - {""}


def test_toxicity_query(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    names = ["toxic", "poor", "both"]
    full = labels.selectExpr("doc_id", "toxic", "1 - quality AS poor", "toxic * (1 - quality) AS both")
    chain = T.train(*T.labelled_sample(docs, full, names), names)
    wanted = []
    for r in docs.collect():
        found = []
        for model in chain.models:
            score = model.bias + sum(model.words[chain.place[w]] for w in plain_words(r.text) if w in chain.place)
            score += sum(p * weight for p, weight in zip(found, model.earlier, strict=True))
            found.append(1 / (1 + math.exp(-max(-30, min(30, score)))))
        wanted.append((r.doc_id, found[0] >= chain.cutoffs[0], *found))
    rows = queries.QUERIES["op7_toxicity"](spark, folder).collect()
    assert sorted(w[:1] for w in wanted) == sorted((r.doc_id,) for r in rows)
    for f, w in zip(sorted((r.doc_id, r.toxic, r.p_toxic, r.p_poor, r.p_toxic_and_poor) for r in rows), sorted(wanted), strict=True):
        assert f[:2] == w[:2] and f[2:] == pytest.approx(w[2:], abs=1e-9)


def test_cutoff_has_the_best_f1():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(20):
        p, y = rng.integers(0, 12, 40) / 12, rng.integers(0, 2, 40).astype(float)

        def f1(at):
            hit = p >= at
            return 2 * (hit * y).sum() / (hit.sum() + y.sum())

        assert f1(T.cutoff(p, y)) == pytest.approx(max(f1(x) for x in p))
    assert T.cutoff(np.array([0.2, 0.9]), np.zeros(2)) == 0.5


def test_held_out_recall(spark):
    """Recall on labels that were not learnt from, with clean documents left alone."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    learn, judge = labels.where("crc32(CAST(doc_id AS STRING)) % 3 <> 0"), labels.where("crc32(CAST(doc_id AS STRING)) % 3 = 0")
    got = T.toxic_documents(docs.join(labels, "doc_id", "left_semi"), learn, ["toxic"]).join(judge, "doc_id")
    rows = [(bool(r.toxic), "toxic" in r.found) for r in got.select("toxic", "found").collect()]
    recall = sum(f for t, f in rows if t) / sum(t for t, _ in rows)
    false = sum(f for t, f in rows if not t) / sum(not t for t, _ in rows)
    assert recall >= 0.9 and false < 0.01
