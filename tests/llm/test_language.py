import zlib

import numpy as np
import pytest

from epiweave.llm import language as G

SCHEMA = "doc_id long, text string, lang string, language string, score string"


def test_gradients_equal_finite_differences():
    network = G.Network.new(["a", "b", "c"], 1)
    for p in network.parameters():
        p *= 0.5
    rng = np.random.default_rng(2)
    steps, labels = rng.integers(0, 8, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    mask = (np.arange(7)[:, None] < np.array([7, 3, 5, 7, 1])).astype(np.float32)
    _, grads = network.gradients(steps, mask, labels)
    for p, g in zip(network.parameters(), grads, strict=True):
        rows = range(8) if p.shape[0] == 256 else range(p.shape[0])
        for i in list(rows)[:4]:
            at = (i, 1) if p.ndim == 2 else (i % p.shape[0],)
            old = p[at]
            losses = []
            for change in (0.01, -0.01):
                p[at] = old + change
                losses.append(network.gradients(steps, mask, labels)[0])
            p[at] = old
            assert g[at] == pytest.approx((losses[0] - losses[1]) / 0.02, abs=2e-3)


def test_every_byte_counts_and_stretches_are_pooled():
    network = G.Network.new(["a", "b"], 1)
    text = "é" * 5000 + "abc" * 5000
    (language, score), _ = G.identify(network, [text, "x"])
    data, total = text.encode(), np.zeros(2)
    for start in range(0, len(data), G.STRETCH):
        matrix, mask = G._matrix([data[start : start + G.STRETCH]], G.STRETCH)
        total += (network.positions(matrix, mask)[0] * mask[..., None]).sum(axis=(0, 1))
    assert language == network.languages[total.argmax()]
    assert score == pytest.approx(total.max() / total.sum(), rel=1e-4)
    assert total.sum() == pytest.approx(len(data), rel=1e-4)


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = G.identify_languages(docs).select("doc_id", "lang", "language.*", G.held_out().alias("held_out")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    outside = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in outside) / len(outside) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    rows = [(i, t, x, "c", "d") for i in range(1, 60) for t, x in [("the cat is on the mat " * 4, "en"), ("le chat est sur la table " * 4, "fr")]]
    odd = [(None, None, None), (None, "", "en"), (5, "123 !?\n", "en"), (6, "the mat " * 40_000, None), (6, "the mat", None), (6, "the mat", None)]
    docs = spark.createDataFrame(rows + [(i, t, x, "c", "d") for i, t, x in odd], SCHEMA)
    out = G.identified_documents(docs)
    assert out.columns == docs.columns
    kept = out.collect()
    assert not [r for r in kept if not r.text or r.text.startswith("1")]
    assert sum(r.doc_id == 6 and r.lang is None for r in kept) == 3
    judged = G.identify_languages(docs.where("text IS NULL OR lang IS NULL OR text = ''")).collect()
    assert {tuple(r.language) for r in judged if not r.text} == {("und", 0.0)}
    assert {tuple(r.language) for r in judged} == {("und", 0.0)}  # nothing to learn from
    assert G.identify_languages(docs.limit(0)).collect() == []


def test_documents_of_low_score_stay(spark, monkeypatch):
    network = G.Network.new(["a", "b", "c", "d"], 1)
    for p in network.parameters():
        p *= 0.01
    monkeypatch.setattr(G, "train", lambda windows: network)
    texts = ["Re.", "A short text.", "123 !?", "", None]
    docs = spark.createDataFrame([(i, t, "a", "", "") for i, t in enumerate(texts)], SCHEMA)
    judged = {r.doc_id: r.language for r in G.identify_languages(docs).collect()}
    assert judged[0].score < 0.5 and judged[1].score < 0.5
    assert {r.doc_id for r in G.identified_documents(docs).collect()} == {0, 1}
