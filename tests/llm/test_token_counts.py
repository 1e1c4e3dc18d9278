import random

import pytest

from epiweave.llm import token_counts as T

SCHEMA = "doc_id long, text string, n string"


def greedy(pieces, word):
    known = {p for p in pieces if p} | set("".join(pieces))
    longest, total, at = max(map(len, known), default=1), 0, 0
    while at < len(word):
        for size in range(min(longest, len(word) - at), 0, -1):
            if word[at : at + size] in known:
                total, at = total + 1, at + size
                break
        else:
            total, at = total + len(word[at].encode()), at + 1
    return total


@pytest.mark.parametrize("seed", range(4))
def test_automaton_equals_greedy_matching(seed):
    rng = random.Random(seed)
    pieces = ["".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 9))) for _ in range(rng.choice([1, 5, 40]))]
    automaton = T.Automaton(pieces)
    for _ in range(400):
        word = "".join(rng.choice("abcé▁") for _ in range(rng.randrange(30)))
        assert automaton.count(word) == greedy(pieces, word), (pieces, word)


def test_long_words_take_linear_time():
    automaton = T.Automaton(["a" * 50, "a" * 49 + "b"])
    assert automaton.count("a" * 1_000_000) == 20_000


def test_public_vocabulary(spark):
    pieces = T.load_pieces("/opt/tokenizers/piece_bpe_32k.model")
    texts = ["Hello wörld, this is  a test\n", "日本語 \U0001f600", " ", "", None, "x" * 100_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "Hello", "a")] * 2, SCHEMA)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_tokens) for r in T.token_counts(docs, pieces).collect())
    wanted = [(i, len((t or "").split()), sum(greedy(pieces, "▁" + w) for w in (t or "").split())) for i, t in enumerate(texts)]
    assert got == [(-1, 1, greedy(pieces, "▁Hello"))] * 2 + wanted


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], SCHEMA), ["a"]).collect() == []
