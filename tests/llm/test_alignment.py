import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from epiweave.llm import alignment as A

BYTES, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, groups long"


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def groups_of(tokenizers, text):
    """Lists (A ids, B ids) of a text, by walking along both token sequences."""
    a, b = tokenizers
    if not text:
        return []
    letters = A.byte_letters()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    data = (" " + text).encode()
    if b"".join(t for _, t in left) != data or b"".join(t for _, t in right) != data:
        return []
    found, i, j = [], 0, 0
    while i < len(left):
        one, other, x, y = [left[i][0]], [right[j][0]], len(left[i][1]), len(right[j][1])
        i, j = i + 1, j + 1
        while x != y:
            if x < y:
                one.append(left[i][0])
                x, i = x + len(left[i][1]), i + 1
            else:
                other.append(right[j][0])
                y, j = y + len(right[j][1]), j + 1
        found.append((one, other))
    return found


def brute(tokenizers, docs):
    all_groups = [groups_of(tokenizers, t) for _, t in docs]
    links = [Counter((a, b) for one, other in g for a in one for b in other) for g in all_groups]
    count = Counter(pair for of in links for pair in of)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, _), groups, of in zip(docs, all_groups, links, strict=True):
        text = ";".join(",".join(map(str, one)) + "|" + ",".join(map(str, other)) for one, other in groups)
        out.append(
            (
                doc_id,
                sum(len(one) for one, _ in groups),
                sum(len(other) for _, other in groups),
                len(groups),
                sum(of.values()),
                sum(n for p, n in of.items() if count[p] == best[p[0]]),
                sum(n * count[p] for p, n in of.items()),
                hashlib.sha256(text.encode()).hexdigest() if text else "",
            )
        )
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def run(spark, docs):
    got = A.align(spark.createDataFrame([(i, t, 7) for i, t in docs], SCHEMA), BYTES, PIECES, digest=True)
    return sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr)


def test_whole_table_equals_plain_loops(spark, tokenizers):
    from epiweave.llm.queries import QUERIES

    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        got = QUERIES["op11_alignment"](spark, folder)
        assert got.columns == [*COLUMNS[:-1], "groups_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(tokenizers, docs)


def test_nulls_repeats_long_and_odd_texts(spark, tokenizers):
    odd = [
        "", None, " ", "  two  spaces ", "\n\n", "\t", "a\x00b", "<s> </s> <unk> <|endoftext|>", "▁mark", "<0x0A>",
        "\U0001f600 naïve café 日本語", "é ﬁ ", "x" * 20_000, "the " * 5_000, " " * 3_000 + "a", "﻿ab", "It's  1234567890",
    ]
    docs = [*enumerate(odd), (None, "the cat"), (None, "the cat"), (3, "  two  spaces "), (3, "other")]
    assert run(spark, docs) == brute(tokenizers, docs)


def test_groups_as_text(spark, tokenizers):
    got = A.align(spark.createDataFrame([(1, "Hello wörld", 0)], SCHEMA), BYTES, PIECES).first()
    wanted = groups_of(tokenizers, "Hello wörld")
    assert got.groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in wanted)


def test_chunks_and_pieces_do_not_matter(spark, tokenizers, monkeypatch):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice(["der", "Wald", "forest.", "42", "née"]) for _ in range(rng.randrange(40)))) for i in range(80)]
    monkeypatch.setattr("epiweave.llm.chunks.CHUNK_BYTES", 100)
    monkeypatch.setattr("epiweave.llm.chunks.PIECE_BYTES", 500)
    assert run(spark, docs) == brute(tokenizers, docs)


def test_both_encoders_agree(tokenizers):
    quick = A.ByteTokenizer(open(BYTES, encoding="utf-8").read())
    assert quick.by_ranks
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), 0x20, 0x0A, 0x1F600])) for _ in range(200))
        assert quick.encode(text) == tokenizers[0].encode(text, add_special_tokens=False).ids


def test_empty_table(spark):
    assert run(spark, []) == []
