import functools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from epiweave.llm import context_tree as C

SCHEMA = "doc_id long, text string, n string"


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def learnt(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 != 0


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


def steps(token, depth):
    """(contexts from none to the longest, bits so far, bit) of every decision of a token."""
    text = token if token == b"\n" else token + b" "
    for i, byte in enumerate(text):
        before = (b" " + text[:i])[-depth:]
        bits = format(byte, "08b")
        for j in range(8):
            yield [before[len(before) - k :] for k in range(len(before) + 1)], bits[:j], int(bits[j])


class Tree:
    """Context-tree weighting, one decision after another."""

    def __init__(self, counted, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for token, n in counted.items():
            for contexts, bits, bit in steps(token, depth):
                for shorter, longer in zip(contexts, contexts[1:], strict=False):
                    self.children[shorter, bits].add(longer)
                for context in contexts:
                    self.counts[context, bits][bit] += n
        self.weighted, self.known = {}, {}

    def lw(self, context, bits):
        if (context, bits) not in self.weighted:
            own = kt(*self.counts[context, bits])
            if self.ends(context):
                self.weighted[context, bits] = own
            else:
                below = sum(self.lw(c, bits) for c in self.children[context, bits])
                self.weighted[context, bits] = np.logaddexp(own, below) - math.log(2)
        return self.weighted[context, bits]

    def ends(self, context):
        return len(context) == self.depth or context.startswith(b" ")

    def p(self, contexts, bits, bit):
        a, b = self.counts[contexts[0], bits]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if self.ends(contexts[0]):
            return own
        here = kt(a, b)
        below = sum(self.lw(c, bits) for c in self.children[contexts[0], bits])
        share = 1 / (1 + math.exp(min(below - here, 700)))
        return share * own + (1 - share) * self.p(contexts[1:], bits, bit)

    def log10(self, token):
        total = 0.0
        for contexts, bits, bit in steps(token, self.depth):
            key = (contexts[-1], bits, bit)
            if key not in self.known:
                self.known[key] = math.log10(self.p(contexts, bits, bit))
            total += self.known[key]
        return total


def brute(docs, depth=C.DEPTH):
    counted = Counter(t for i, text in docs if learnt(i) for t in tokens(text))
    everything, distinct = sum(counted.values()), len(counted)
    tree = Tree(counted, depth)
    log10 = functools.cache(tree.log10)
    out = []
    for i, text in docs:
        of = tokens(text)
        base = sum(math.log10((counted[t] + 0.1) / (everything + 0.1 * (distinct + 1))) for t in of)
        score = sum(map(log10, of))
        out.append((i, not learnt(i), len(of), sum(counted[t] > 0 for t in of), everything, base, score))
    return out


def run(spark, docs):
    rows = C.lm_scores(spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA)).collect()
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return sorted((tuple(r[n] for n in names) for r in rows), key=repr)


def compare(spark, docs):
    got, wanted = run(spark, docs), sorted(brute(docs), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in wanted]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in wanted for x in w[5:]], rel=1e-7)
    return got


def test_whole_table_equals_plain_loops(spark):
    from epiweave.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in QUERIES["op13_lm_scores"](spark, folder).collect()}
    for w in brute(docs):
        got = rows[w[0]]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == w[1:5]
        assert (got.base_score, got.score) == pytest.approx(w[5:], rel=1e-7)
        assert got.bits_per_byte == pytest.approx(-got.score * math.log2(10) / got.n_bytes)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.n_bytes * r.bits_per_byte for r in held) < 3.5 * sum(r.n_bytes for r in held)


def test_nulls_repeats_long_and_odd_texts(spark):
    docs = [(i, t) for i, t in enumerate(["", None, " \t\n", "A b\x0bA", "caf\xe9 \U0001f600", "\x00 \x00\x00", "x" * 50_000])]
    compare(spark, docs + [(None, "A b"), (None, None), (3, "A b\x0bA"), (3, "other")])


def test_chunks_do_not_matter(spark, monkeypatch):
    docs = [(i, f"word{i % 7} wort{i % 11} other {i}") for i in range(60)]
    whole = run(spark, docs)
    monkeypatch.setattr("epiweave.llm.chunks.CHUNK_BYTES", 1)
    again = run(spark, docs)
    assert [r[:5] for r in again] == [r[:5] for r in whole]
    assert [x for r in again for x in r[5:]] == pytest.approx([x for r in whole for x in r[5:]])


def test_nothing_to_learn_from(spark):
    assert run(spark, [(None, "ab")])[0][2:] == (2, 0, 0, 0.0, pytest.approx(-32 * math.log10(2)))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_levels_share_what_deeper_contexts_lack():
    counted = Counter({b"abcab": 5, b"xbca": 2, b"q": 1})
    tree = Tree(counted, 3)
    for contexts, bits, _ in steps(b"zbcab", 3):
        assert tree.p(contexts, bits, 0) + tree.p(contexts, bits, 1) == pytest.approx(1)
