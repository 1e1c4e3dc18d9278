import random
from collections import defaultdict

import pandas as pd
import pytest

from epiweave.llm import line_dedup as L

SCHEMA = "doc_id long, text string, pos string, h1 string"


def brute(texts, min_chars=20, min_docs=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def found(df):
    return {r.doc_id: tuple(r.deduped) for r in df.collect()}


@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_brute_force(spark, partitions):
    rng = random.Random(1)
    pool = [f"line number {i} of the common pool é" for i in range(30)]
    texts = {}
    for i in range(300):
        lines = rng.choices(pool, k=rng.randrange(6)) + [f"own line {i} which nobody else has"]
        if i % 3 == 0:  # a line that a third of all documents hold, in other case and with spaces
            lines += ["  The Very Common Line of Them All\t", "the very common line of them all"]
        if i % 50 == 1:
            lines += ["É" * 19 + "A", "É" * 18 + "a", "", ""]
        rng.shuffle(lines)
        texts[i] = "\n".join(lines)
    texts |= {1000: None, 1001: "", 1002: "\n\n", 1003: "\n".join(pool) * 50 + "\n" + "x" * 400_000}
    docs = spark.createDataFrame([(i, t, "p", "q") for i, t in texts.items()], SCHEMA).repartition(partitions)
    df = L.dedup_lines(docs)
    assert df.columns == [*docs.columns, "deduped"]
    assert found(df) == brute(texts)


def test_null_and_repeated_ids(spark):
    line = "a line that is long enough"
    rows = [(None, line), (None, line + "\nx"), (5, line), (5, line), (7, line + "\nkept")]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, tuple(r.deduped)) for r in L.dedup_lines(docs).collect())
    assert got == [(0, ("", 1, 1)), (0, ("x", 2, 1)), (5, ("", 1, 1)), (5, ("", 1, 1)), (7, (line + "\nkept", 2, 0))]
    two_ids = docs.where("doc_id IS NOT NULL")  # repeated rows of one id are one document
    assert {r.deduped.n_dropped for r in L.dedup_lines(two_ids).collect()} == {0}


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("cuts", [[1, 2, 3, 10], [4], [1, 1, 1, 1, 1, 1, 1], []])
def test_streamed_runs_do_not_depend_on_batches(cuts):
    rows = [(1, 1, d) for d in (9, 9, 8, 7, 6)] + [(1, 2, d) for d in (5, 4)] + [(2, 0, d) for d in (9, 8, 7, 3)]
    rows += [(3, 3, d) for d in (9, 8, 7, 6)]
    frame = pd.DataFrame(rows, columns=["h1", "h2", "doc_id"]).assign(text_key=0, pos=range(len(rows)))
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    runs, parts, start = L._Runs(3), [], 0
    for end in [*[sum(cuts[: i + 1]) for i in range(len(cuts))], len(rows)]:
        if end > start:
            parts += list(runs.feed(frame.iloc[start:end].reset_index(drop=True)))
        start = end
    parts += list(runs.finish())
    out = pd.concat(parts)
    kinds = {k: sorted(g["pos"]) for k, g in out.groupby("kind")}
    assert kinds[L.OPEN] == [0, 1, 2, 3, 4]  # the first run may have begun in another partition
    assert kinds[L.DROPPED] == [8, 9, 10, 12, 13, 14]
    assert kinds[L.EVIDENCE] == [11, 12, 13]
