import hashlib
import random
import re

import pytest
import xxhash

from epiweave.llm import fingerprints as P

SCHEMA = "doc_id long, text string, print string, slice string, next string"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def bins(text):
    """Least 55-bit hash of each of 256 bins that has one."""
    out = {}
    for shingle in shingles(text):
        h = 42
        for word in shingle:
            h = xxhash.xxh64_intdigest(word.encode(), h)
        h &= (1 << 63) - 1
        out[h >> 55] = min(out.get(h >> 55, h), h)
    return out


def brute_print(text):
    filled = bins(text)
    if not filled:
        return ""

    def of(*values):
        h = 42
        for v, size in values:
            h = xxhash.xxh64_intdigest((v & (1 << 8 * size) - 1).to_bytes(size, "little"), h)
        return signed(h)

    def value(i):
        if i in filled:
            return filled[i]
        tried = (of((i, 4), (t, 4)) % 256 for t in range(P.TRIES))
        first = next((filled[other] for other in tried if other in filled), None)
        if first is None:
            first = min((of((i, 4), (b, 8), (-1, 4)), y) for b, y in filled.items())[1]
        return of((first, 8), (i, 4))

    return "".join(f"{value(i) & 15:x}" for i in range(256))


def corpus():
    rng = random.Random(7)
    pool = [f"word{i}" for i in range(500)] + ["É", "Ünï"]
    texts = {i: " ".join(rng.choices(pool, k=rng.choice([1, 3, 4, 5, 6, 20, 60, 200, 700, 1500]))) for i in range(0, 90, 2)}
    texts |= {91: None, 93: "", 95: " \n\t", 97: texts[0], 99: texts[0].upper(), 101: "x " * 50_000, 103: "日本語 テキスト"}
    for i in range(200, 215):
        part = texts[88 - 2 * (i % 5)].split()
        part[rng.randrange(len(part))] = "changed"
        texts[i] = " ".join(part)
    return texts


@pytest.mark.parametrize("per_slice", [5, 2000])
def test_equals_brute_force(spark, per_slice):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in texts.items()], SCHEMA).repartition(6)
    got = {r.doc_id: r for r in P.edited_fingerprints(docs, per_slice).collect()}
    ids = sorted(texts, reverse=True)
    for place, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(place + 1) % len(ids)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute_print(text) and r.edited_fingerprint == brute_print(edited)
        assert abs(r.near_edited - likeness(text, edited)) < 0.16 and 0 <= r.near_edited <= 1
        assert abs(r.near_next - likeness(text, after)) < 0.16


def test_likeness_is_unbiased(spark):
    rng = random.Random(1)
    rows, wanted = [], []
    for share in (0.0, 0.3, 0.8, 1.0):
        for _ in range(25):
            a = [f"u{rng.randrange(10**9)}" for _ in range(400)]
            keep = int(share * 400)
            rows.append((" ".join(a), " ".join(a[:keep] + [f"u{rng.randrange(10**9)}" for _ in range(400 - keep)])))
            wanted.append((share, likeness(*rows[-1])))
    df = P.with_fingerprint(spark.createDataFrame(rows, "a string, b string"), "a", "pa")
    df = P.with_fingerprint(df, "b", "pb").select("a", P.likeness("pa", "pb").alias("l"))
    found = {r.a: r.l for r in df.collect()}
    for share in (0.3, 0.8, 1.0):
        errors = [found[a] - x for (a, _), (s, x) in zip(rows, wanted, strict=True) if s == share]
        assert abs(sum(errors) / len(errors)) < 0.03


def test_null_and_repeated_ids(spark):
    rows = [(None, "n o p q r s"), (None, "a"), (3, "same row"), (3, "same row"), (1, "t")]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    pairs = [(r.text, r.next_text) for r in P.with_next_text(docs, 1).collect()]
    follow = sorted(pairs, key=str)
    assert sorted(b for _, b in follow) == sorted(t for _, t in rows)  # a ring
    assert ("same row", "same row") in pairs and ("same row", "t") in pairs
    single = P.edited_fingerprints(docs.where("doc_id = 1")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    assert P.edited_fingerprints(docs.limit(0)).collect() == []
    assert P.fingerprints(docs).count() == 5


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "", "", "")], SCHEMA)
    plan = P.edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
