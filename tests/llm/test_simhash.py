import numpy as np
import pytest
import xxhash

from epiweave.llm import simhash as S
from epiweave.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, label string, v int"


def brute(texts):
    """Fingerprint and component of {doc_id: text} by plain loops."""
    prints = {}
    for i, text in texts.items():
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if w]
        shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    group = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {i: (f"{prints[i]:016x}", group[i]) for i in texts}


def found(df):
    return {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()}


def test_groups_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words, 120)) for _ in range(12)]
    texts = {i: t for i, t in enumerate(base)}
    for i in range(12, 90):
        parts = base[i % 12].split()
        for _ in range(i % 3):
            parts[rng.integers(len(parts))] = "Edit"
        texts[i] = " ".join(parts)
    texts |= {200: "", 201: None, 202: " \n\t", 203: "one", 204: "One", 205: "one two", 206: "x " * 300_000}
    rows = [(i, t, "clash", "clash", 1) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert found(S.near_duplicate_groups(docs)) == brute({i: t if i != 206 else "x " * 300 for i, t in texts.items()})


@pytest.mark.parametrize("hot", [0, 1 << 20])
def test_links_equal_all_pairs(spark, hot):
    rng = np.random.default_rng(5)
    center = int(rng.integers(2**62))
    values = {center, 0, -1}
    while len(values) < 250:
        flips = rng.choice(64, rng.integers(1, 5), replace=False)
        x = int(np.int64(np.uint64(center & (2**64 - 1)) ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))))
        values.add(x)
    values = sorted(values)
    links = S.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, hot)
    got = {(min(r), max(r)) for r in map(tuple, links.collect())}
    wanted = {
        (a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    }
    assert got == wanted


def test_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1001 + i) for i in range(200)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (9, 8)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(201)}


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d", "x", None, 1), (1, "a b c d", "y", None, 2), (1, "a b c d", "y", None, 2),
            (None, "a b c d", "z", None, 3), (None, "only me and nobody", "z", None, 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = S.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.v) for r in kept.collect()) == [(-1, 4), (1, 2)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicate_groups(docs).collect() == []
    assert S.one_of_each_group(docs).collect() == []
