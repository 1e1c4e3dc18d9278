import random
from collections import Counter

import numpy as np
import pytest

from epiweave.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, first string, core string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((kept, len(d), len(d) - len(kept), runs))
    return out


def found(df):
    return sorted((r.doc_id, bytes(r.cut.kept), r.cut.n_bytes, r.cut.n_removed, r.cut.n_spans) for r in df.collect())


def corpus(length, seed=2):
    rng = random.Random(seed)

    def words(n):
        return "".join(rng.choice("abcdé ") for _ in range(n))

    passages = [words(k) for k in (length - 1, length, length + 1, 2 * length, 3 * length + 5)]
    texts = [words(rng.randrange(40)) + rng.choice(passages) + words(rng.randrange(60)) for _ in range(60)]
    base = words(8 * length)
    for _ in range(20):  # near copies
        at = rng.randrange(len(base))
        texts.append(base[:at] + "#" + base[at + 1 :])
    texts += [texts[0], texts[0], base, base, None, "", "x" * (3 * length), "ab" * length, "q" * length, "short"]
    texts += [words(length) + "tail" + texts[1], texts[1][3:]]
    if length < 100:  # longer than a chunk
        long = words(600_000)
        texts += [long, "x" + long[250_000:300_000] + "y"]
    return texts


@pytest.mark.parametrize("length", [24, 200])
def test_equals_brute_force(spark, length):
    texts = corpus(length)
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in enumerate(texts)], SCHEMA).repartition(5)
    df = S.remove_repeats(docs, length)
    assert df.columns == [*docs.columns, "cut"]
    assert found(df) == [(i, *row) for i, row in enumerate(brute(texts, length))]


def test_anchors_stand_for_every_suffix_once():
    d, rng = S.Digits(200), random.Random(4)
    text = np.frombuffer("".join(rng.choice("abc") for _ in range(3000)).encode(), np.uint8)
    _, _, first, last, at = S.anchor_rows(text, 0, d)
    assert list(first) == [0, *(last[:-1] + 1)] and last[-1] == len(text) - 200
    assert (np.diff(at) > 0).all() and ((at >= last) & (at <= first + d.reach())).all()
    _, _, begin, end = S.cell_rows(text, [first, last, at], 0, d)
    assert sorted(i for a, b in zip(begin, end, strict=True) for i in range(a, b + 1)) == list(range(len(text) - 199))


def test_small_chunks_change_nothing(monkeypatch):
    d, texts = S.Digits(24), corpus(24, 5)
    data = np.frombuffer("".join(t or "" for t in texts[:90]).encode(), np.uint8)
    whole = S.suffix_rows(data, [np.array([3]), np.array([len(data) - 24])], 0, d)
    assert len(set(whole[0])) == len({bytes(data[i : i + 24]) for i in whole[2]})
    monkeypatch.setattr(S, "CHUNK", 300)
    again = S.suffix_rows(data, [np.array([3]), np.array([len(data) - 24])], 0, d)
    assert all((a == b).all() for a, b in zip(whole, again, strict=True))
    _, _, first, last, _ = S.anchor_rows(data, 0, d)
    assert (last - first + 1).sum() == len(data) - 23


def test_null_and_repeated_ids(spark):
    line = "a passage of well over twenty-four bytes"
    rows = [(None, line), (None, line + "!"), (1, "only once but long enough to be cut"), (2, "twice the very same row, " * 2)]
    rows.append(rows[-1])
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, bytes(r.cut.kept).decode()) for r in S.remove_repeats(docs, 24).collect())
    assert got == [(0, ""), (0, "!"), (1, rows[2][1]), (2, ""), (2, "")]


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA), 24).collect() == []
