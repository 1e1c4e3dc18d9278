import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from epiweave.llm import variants as V

SCHEMA = "doc_id long, text string, key long"


def occurrences(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(docs):
    """Rows by word; only words that share all but one place are compared."""
    n = occurrences(docs)
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "*" + w[i + 1 :]].add(w)
            holes[w[:i] + w[i + 1 :]].add(w)
        holes[w].add(w)
    near = defaultdict(set)
    for group in holes.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in n:
        best = min(near[w], key=lambda b: (-n[b], b), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def run(spark, docs):
    got = V.spelling_variants(spark.createDataFrame([(i, t, 0) for i, t in docs], SCHEMA))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_whole_table_equals_plain_loops(spark):
    from epiweave.llm.queries import QUERIES

    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        got = [tuple(r) for r in QUERIES["op12_spelling_variants"](spark, folder).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(docs)
        assert any(r[1] for r in got)


@pytest.mark.parametrize("symbols", [1, 2, 8])
def test_neighbourhoods_meet_every_pair_once(symbols):
    rng = random.Random(symbols)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randrange(3, 7))) for _ in range(300)})
    keys = V.reduced_keys(words, symbols).tolist()
    owner, other = V.neighbourhood(words, symbols, 3)
    found = Counter(zip(owner.tolist(), other.tolist(), strict=True))
    assert max(found.values()) == 1
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if one_edit(a, b):
                assert (i, keys[j]) in found or (j, keys[i]) in found
                assert keys[i] == keys[j] or not ((i, keys[j]) in found and (j, keys[i]) in found)


def test_chains_ties_and_copies(spark):
    words = ["chainaa"] * 1000 + ["chainab"] * 100 + ["chainbb"] * 9 + ["tiedaaa"] * 20 + ["tiedbaa"] * 20 + ["tiedcaa"] * 2
    docs = [(i, f"{w.title()}!") for i, w in enumerate(words)] * 2
    got = run(spark, docs)
    assert got == brute(docs)
    assert {r[0]: r[2] for r in got}["chainbb"] == "chainaa"


def test_nulls_long_and_odd_texts(spark):
    long = "a" * 3000
    docs = [(i, t) for i, t in enumerate([None, "", "Élanvital élanvital", "under_scores", f"{long} {long}b {long} {long}b"])]
    docs += [(None, "weights weights weight")] * 2 + [(2, "\U0001f600abcdefg×abcdefg")]
    got = run(spark, docs)
    assert got == brute(docs)
    assert {len(r[0]) for r in got} >= {3000, 3001}


def test_empty_table(spark):
    assert run(spark, []) == set()
