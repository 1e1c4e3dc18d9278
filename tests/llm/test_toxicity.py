import random

import numpy as np

from epiweave.llm import toxicity as T

SCHEMA = "doc_id long, text string, toxic string, words string"
BAD, RUDE = ["grumph", "zorble"], ["snark", "fleb"]


def corpus(n=900):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        toxic, rude = i % 7 == 0, i % 7 == 0 and i % 2 == 0
        for bad, on in ((BAD, toxic), (RUDE, rude)):
            if on:
                words[rng.randrange(len(words))] = rng.choice(bad).upper() + "!"
        docs.append((i, " ".join(words), "x", "y"))
        labels.append((i, int(toxic), int(rude)))
    return docs, labels


def test_planted_categories_are_found(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, SCHEMA)
    learn = spark.createDataFrame([r for r in labels if r[0] % 3], "doc_id long, insult int, rude int")
    out = T.toxicity(frame, learn, ["insult", "rude"])
    assert out.columns == [*frame.columns, "toxicity"]
    got = {r.doc_id: tuple(r.toxicity) for r in out.collect()}
    unseen = [r for r in labels if r[0] % 3 == 0]
    for column in (0, 1):
        right = [(got[r[0]][column] >= 0.5) == bool(r[column + 1]) for r in unseen]
        assert np.mean(right) > 0.97, column


def test_later_models_use_out_of_fold_probabilities():
    docs, labels = corpus()
    words = [T.distinct_words(t) for _, t, *_ in docs]
    y = np.array([r[1:] for r in labels])
    chain = T.train(words, y, ["insult", "rude"])
    assert [len(m.earlier) for m in chain.models] == [0, 1]
    found = chain.predict(words)
    rows = T.Rows([chain._indexes(w) for w in words], len(chain.place))
    again = chain.models[1].predict(rows, found[:, :1])
    assert np.allclose(found[:, 1], again)


def test_edge_cases(spark):
    docs, labels = corpus(60)
    odd = [(None, "grumph", "", ""), (None, None, "", ""), (1000, "", "", ""), (1000, "grumph " * 100_000, "", "")] * 2
    frame = spark.createDataFrame(docs + odd, SCHEMA)
    learn = spark.createDataFrame([*labels, (None, 1, 1), (3, None, 1), (1000, 1, 0)], "doc_id long, insult int, rude int")
    rows = T.toxicity(frame, learn, ["insult", "rude"]).collect()
    assert len(rows) == len(docs) + len(odd)
    assert all(0 <= p <= 1 for r in rows for p in r.toxicity)
    nothing = T.toxicity(frame, learn.limit(0), ["insult", "rude"]).collect()
    assert {tuple(r.toxicity) for r in nothing} == {(0.5, 0.5)}
    assert T.toxicity(frame.limit(0), learn, ["insult", "rude"]).collect() == []
