import itertools
import random

import corpus_pipeline
import numpy as np

from epiweave.llm import decontamination as D
from epiweave.llm import queries

SCHEMA = "doc_id long, text string, hash string, tokens string"


def tokens(text):
    return D._TOKENS.findall(text.lower()) if text else []


def brute(docs, items):
    """Pairs (doc, item) with 13 aligned tokens of which 11 agree (a shorter item: all)."""
    out = set()
    for (i, a), (j, b) in itertools.product(docs.items(), items.items()):
        a, b = np.array(tokens(a), object), np.array(tokens(b), object)
        if len(b) < D.MIN_TOKENS:
            continue
        width = min(13, len(b))
        needed = 11 if width == 13 else width
        if len(a) >= width:
            same, n, m = a[:, None] == b[None, :], len(a) - width + 1, len(b) - width + 1
            if sum(same[k : k + n, k : k + m].astype(int) for k in range(width)).max() >= needed:
                out.add((i, j))
    return out


def test_masks_hit_every_window_with_two_substitutions():
    for wrong in itertools.combinations(range(13), 2):
        assert any(
            all(mask[k] == "0" or at + k not in wrong for k in range(len(mask)))
            for mask in D.MASKS
            for at in range(13 - len(mask) + 1)
        ), wrong


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {j: " ".join(rng.choices(vocabulary, k=n)) for j, n in enumerate([30, 13, 14, 40, 12, 5, 4, 0])}
    items |= {8: None, 9: items[0], 10: "The, CASE and. marks! do not-matter here at all, so be it my friend"}
    docs = {}
    for i in range(60):
        part = items[rng.choice([0, 1, 2, 3, 4, 5, 6, 10])].split()
        for _ in range(i % 4):
            part[rng.randrange(len(part))] = "wrong"
        docs[i] = " ".join([*rng.choices(vocabulary, k=rng.randrange(30)), *part, *rng.choices(vocabulary, k=5)])
    docs |= {100: None, 101: "", 102: "w1", 103: "the case AND marks do not matter here at all so be it", 104: "w2 " * 100_000}
    docs[105] = " ".join(items[0].split()[:15]) + " " + " ".join(items[3].split()[-14:])
    return docs, items


def test_equals_brute_force(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs.items()], SCHEMA).repartition(4)
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.benchmark_hits(frame, tests, short_similarity=1.0).collect()}
    wanted = brute({i: t for i, t in docs.items() if i != 104}, items)
    assert got == wanted
    held = {i for i, _ in wanted}
    rows = D.contamination(frame, tests, short_similarity=1.0).collect()
    assert {r.doc_id: r.contaminated for r in rows} == {i: i in held for i in docs}
    clean = D.clean_documents(frame, tests, short_similarity=1.0)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == set(docs) - held


def test_overfull_map_changes_nothing(spark, monkeypatch):
    docs, items = corpus()
    del docs[104]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs.items()], SCHEMA)
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    full = np.full(D.MAP_BITS // 64, 2**64 - 1, np.uint64)
    monkeypatch.setattr(D, "hash_map", lambda _: full)
    assert {(r.doc_id, r.item_id) for r in D.benchmark_hits(frame, tests, short_similarity=1.0).collect()} == brute(docs, items)


def test_null_and_repeated_ids_and_empty_tables(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(None, text, "", ""), (None, "clean", "", ""), (1, text, "", ""), (1, text, "", "")], SCHEMA)
    items = spark.createDataFrame([(7, text)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.contaminated) for r in D.contamination(docs, items).collect())
    assert got == [(0, False), (0, True), (1, True), (1, True)]
    assert [r.text for r in D.clean_documents(docs, items).collect()] == ["clean"]
    assert D.clean_documents(docs, items.limit(0)).count() == 4
    assert D.contamination(docs.limit(0), items).count() == 0


def test_items_without_id_are_searched(spark):
    passages = [" ".join(f"{a}{i}" for i in range(15)) for a in "abc"]
    items = spark.createDataFrame([(None, passages[0]), (None, passages[1]), (7, passages[2])], "item_id long, text string")
    texts = {1: passages[0], 2: f"{passages[1]} {passages[0]}", 3: passages[2], 4: "clean"}
    docs = spark.createDataFrame([(i, f"x y {t} z", "", "") for i, t in texts.items()], SCHEMA)
    assert {r.doc_id: r.n_items for r in D.contamination(docs, items).collect()} == {1: 1, 2: 2, 3: 1, 4: 0}
    assert [r.doc_id for r in D.clean_documents(docs, items).collect()] == [4]


def test_short_masks_hit_every_run_with_a_fifth_substituted():
    assert set(D.SHORT_MASKS) == set(range(5, 13))
    for n, masks in D.SHORT_MASKS.items():
        for wrong in itertools.combinations(range(n), n // 5):
            assert any(
                all(mask[k] == "0" or at + k not in wrong for k in range(len(mask)))
                for mask in masks
                for at in range(n - len(mask) + 1)
            ), (n, wrong)


def near(doc, item):
    """Whether all aligned tokens of a short item but a fifth agree with a run of the document's."""
    a, b = tokens(doc), tokens(item)
    runs = (a[i : i + len(b)] for i in range(len(a) - len(b) + 1))
    return any(sum(map(str.__eq__, run, b)) >= len(b) - len(b) // 5 for run in runs)


def test_short_items_with_substitutions(spark):
    rng = random.Random(5)
    items = {n: " ".join(f"v{n}x{i}" for i in range(n)) for n in range(1, 13)}
    docs = {}
    for n, item in items.items():
        for wrong in range(4):
            for ends in range(4):
                part = item.split()
                for at in rng.sample(range(n), min(wrong, n)):
                    part[at] = "wrong"
                docs[len(docs)] = " ".join(["a"] * (ends % 2) + part + ["b"] * (ends // 2))
        docs[len(docs)] = " ".join(item.split()[1:])  # a token short of the item
        docs[len(docs)] = " ".join(item.split()[:-1])
    docs[len(docs)] = f"{items[1]} {items[4]} z " * 500
    wanted = {(i, n) for i, t in docs.items() for n, item in items.items() if near(t, item)}
    frame = spark.createDataFrame([(i, t, "", "") for i, t in docs.items()], SCHEMA)
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    hits = D.benchmark_hits(frame, tests, short_similarity=D.SHORT_SIMILARITY)
    assert {(r.doc_id, r.item_id) for r in hits.collect()} == wanted
    exact = {(r.doc_id, r.item_id) for r in D.benchmark_hits(frame, tests, short_similarity=1.0).collect()}
    assert exact == {(i, n) for i, n in wanted if f" {items[n]} " in f" {docs[i]} "} and len(exact) < len(wanted)


def test_query_and_pipeline_search_short_items_with_substitutions(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, item.replace("four", "x"), "", ""), (2, "one two x four x six x eight nine ten", "", ""), (3, "so yes", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = spark.createDataFrame([(1, item), (2, "Yes")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    judged = queries.QUERIES["op4_decontamination"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_items for r in judged} == {1: 1, 2: 0, 3: 1}
    assert [r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()] == [2]
