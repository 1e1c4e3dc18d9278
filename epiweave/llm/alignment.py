"""Token alignment between a byte-level and a piece tokenizer over the same texts."""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiweave.llm.chunks import Packer, key_totals, looked_up, packed, scratch
from epiweave.llm.common import small_batches, stored, text_key

MARK = "▁"
#: Fixed value: the pattern by which byte-level tokenizers cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs of white space overflow the stack of the quicker encoder.
_LONG_BLANK = re.compile(r"\s{500}")
#: Documents whose space-and-text a tokenizer is given at once.
_AT_ONCE = 256


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else 256 and up."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokenizer:
    """Ids of a byte-level tokenizer file; strings of special tokens are plain text.

    Where the file's merges follow its ids, as the encoder by ranks needs it, that one is used: it gives
    the same ids in a quarter of the time.
    """

    def __init__(self, spec: str):
        self.spec = spec
        content = json.loads(spec)
        letters = byte_letters()
        self.ranks = {bytes(letters[c] for c in t): i for t, i in content["model"]["vocab"].items() if set(t) <= letters.keys()}
        self.token_bytes = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.token_bytes[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
        order = [content["model"]["vocab"]["".join(m)] for m in merges]
        cut = content["pre_tokenizer"] or {}
        self.by_ranks = (
            order == list(range(order[0], order[0] + len(order)))
            and order[0] == 256
            and content["normalizer"] is None
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
            and len(self.ranks) == len(content["model"]["vocab"])
        )

    @cached_property
    def _slow(self):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(self.spec)
        whole.encode_special_tokens = True
        return whole

    @cached_property
    def _quick(self):
        import tiktoken

        return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.by_ranks and not _LONG_BLANK.search(text):
            return self._quick.encode_ordinary(text)
        return self._slow.encode(text, add_special_tokens=False).ids


class PieceTokenizer:
    """Ids of a sentencepiece model, which puts a space before the text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.token_bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(MARK, " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + sizes[i] - 1 of all i, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Windows:
    """Alignments of token-id windows, worked out once for each pair of id tuples.

    A window's tokens of both sides cover the same bytes. ``place`` numbers the windows seen;
    the lists and arrays beside it tell of each its groups, their number, its links and its distinct id pairs.
    """

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.a_size = np.fromiter(map(len, a_bytes), np.int64, len(a_bytes))
        self.b_size = np.fromiter(map(len, b_bytes), np.int64, len(b_bytes))
        self.a_text = [str(i) for i in range(len(a_bytes))]
        self.b_text = [str(i) for i in range(len(b_bytes))]
        self.forget()

    def forget(self) -> None:
        self.place: dict[tuple[bytes, bytes], int] = defaultdict(lambda: len(self.place))
        self.pair_place: dict[int, int] = defaultdict(lambda: len(self.pair_place))
        self.texts: list[str] = []
        self.n_groups = np.empty(0, np.int64)
        self.n_links = np.empty(0, np.int64)
        self.pairs = np.empty(0, np.int32)
        self.times = np.empty(0, np.int64)
        self.n_pairs = np.empty(0, np.int64)
        self.first_pair = np.empty(0, np.int64)

    def places(self, a: np.ndarray, a_cuts: np.ndarray, b: np.ndarray, b_cuts: np.ndarray) -> np.ndarray:
        """The place of each window: ``a`` and ``b`` cut at the given places, from 0 to their ends."""
        known = len(self.place)
        a_all, b_all = a.astype(np.int32).tobytes(), b.astype(np.int32).tobytes()
        a_at, b_at = (4 * a_cuts).tolist(), (4 * b_cuts).tolist()
        ids = [
            (a_all[i:j], b_all[k:m])
            for i, j, k, m in zip(a_at, a_at[1:], b_at, b_at[1:], strict=False)
        ]
        found = np.fromiter(map(self.place.__getitem__, ids), np.int64, len(ids))
        _, first = np.unique(found, return_index=True)
        new = first[found[first] >= known]
        if len(new):
            a_sizes, b_sizes = np.diff(a_cuts)[new], np.diff(b_cuts)[new]
            self._align(a[_ranges(a_cuts[new], a_sizes)], a_sizes, b[_ranges(b_cuts[new], b_sizes)], b_sizes)
        return found

    def _align(self, a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> None:
        """Groups, links and pairs of windows that stand one after the other."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        window_end = a_end[np.cumsum(a_sizes) - 1]
        ends = np.zeros(a_end[-1] + 1, np.uint8)
        ends[a_end] = 1
        ends[b_end] += 2
        shared = np.flatnonzero(ends == 3)
        window = np.searchsorted(window_end, shared)
        a_group, b_group = np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)
        in_a, in_b = np.bincount(a_group), np.bincount(b_group)
        count = len(window_end)
        groups = np.bincount(window, minlength=count)
        self.n_groups = np.concatenate([self.n_groups, groups])
        self.n_links = np.concatenate([self.n_links, np.bincount(window, in_a * in_b, count).astype(np.int64)])

        a_text, b_text = [self.a_text[i] for i in a.tolist()], [self.b_text[i] for i in b.tolist()]
        a_at, b_at = [0, *np.cumsum(in_a).tolist()], [0, *np.cumsum(in_b).tolist()]
        text = [
            f"{','.join(a_text[i:j])}|{','.join(b_text[k:m])}"
            for i, j, k, m in zip(a_at, a_at[1:], b_at, b_at[1:], strict=False)
        ]
        at = [0, *np.cumsum(groups).tolist()]
        self.texts += [";".join(text[i:j]) for i, j in zip(at, at[1:], strict=False)]

        # ids that repeat in a group are paired once, with the product of their numbers
        a_ids, a_times = np.unique(a_group << 32 | a, return_counts=True)
        b_ids, b_times = np.unique(b_group << 32 | b, return_counts=True)
        b_distinct = np.bincount(b_ids >> 32)
        of_a = b_distinct[a_ids >> 32]
        left = np.repeat(np.arange(len(a_ids)), of_a)
        right = _ranges((np.cumsum(b_distinct) - b_distinct)[a_ids >> 32], of_a)
        code = (a_ids[left] & 0xFFFFFFFF) << 32 | b_ids[right] & 0xFFFFFFFF
        pairs = np.fromiter(map(self.pair_place.__getitem__, code.tolist()), np.int32, len(code))
        n_pairs = np.bincount(window[a_ids[left] >> 32], minlength=count)
        self.first_pair = np.concatenate([self.first_pair, len(self.pairs) + np.cumsum(n_pairs) - n_pairs])
        self.n_pairs = np.concatenate([self.n_pairs, n_pairs])
        self.pairs = np.concatenate([self.pairs, pairs])
        self.times = np.concatenate([self.times, a_times[left] * b_times[right]])


def shared_starts(
    a: np.ndarray, a_sizes: np.ndarray, a_marked: np.ndarray, b: np.ndarray, b_sizes: np.ndarray, b_marked: np.ndarray,
    texts: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes at which the windows of texts begin, and the token places of either side, their ends last.

    A window begins where on both sides a token ends at the same byte and one that is marked with a space
    begins, and where a text begins (``texts``).
    """
    a_start = np.cumsum(a_sizes[a]) - a_sizes[a]
    b_start = np.cumsum(b_sizes[b]) - b_sizes[b]
    marks = np.zeros(a_start[-1] + a_sizes[a[-1]] + 1, np.uint8)
    marks[a_start[a_marked[a]]] = 1
    marks[b_start[b_marked[b]]] += 2
    marks[texts] = 3
    cuts = np.flatnonzero(marks == 3)
    return cuts, np.append(np.searchsorted(a_start, cuts), len(a)), np.append(np.searchsorted(b_start, cuts), len(b))


class _Aligned(Packer):
    """Documents with their alignment and the distinct id pairs they link."""

    key = pa.int64()
    fields = [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups", pa.string()),
        ("places", pa.binary()),
        ("times", pa.binary()),
    ]

    def __init__(self, byte_spec: str, piece_model: bytes, digest: bool):
        self.a, self.b, self.digest = ByteTokenizer(byte_spec), PieceTokenizer(piece_model), digest
        self.windows = Windows(self.a.token_bytes, self.b.token_bytes)
        self.marked = [np.array([t.startswith(b" ") for t in side.token_bytes]) for side in (self.a, self.b)]

    def start(self) -> None:
        self.windows.forget()
        self.held = np.empty(0, np.int64)

    def keys(self) -> tuple[pa.Array, pa.Array]:
        pairs = self.windows.pair_place
        held = np.concatenate([self.held, np.zeros(len(pairs) - len(self.held), np.int64)])
        return pa.array(list(pairs), pa.int64()), pa.array(held)

    def add(self, batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column("text").to_pylist()
        rows: list[tuple] = [(0, 0, 0, 0, "", b"", b"")] * len(texts)
        equal, sides = [], []
        full = [i for i, t in enumerate(texts) if t]
        for at in range(0, len(full), _AT_ONCE):
            some = full[at : at + _AT_ONCE]
            for i, b in zip(some, self.b.encode([texts[i] for i in some]), strict=True):
                text = " " + texts[i]
                ids = (self.a.encode(text), b)
                data = text.encode()
                joined = (b"".join(map(t.token_bytes.__getitem__, x)) for t, x in zip((self.a, self.b), ids, strict=True))
                if all(j == data for j in joined):
                    equal.append(i)
                    sides.append((len(data), *(np.array(x, np.int64) for x in ids)))
        if equal:
            for i, row in zip(equal, self._aligned(*zip(*sides, strict=True)), strict=True):
                rows[i] = row
        columns = zip(*rows, strict=True)
        types = [t for _, t in self.fields[2:]]
        given = [batch.column("doc_id"), batch.column("text_key")]
        return [*given, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]

    def _aligned(self, sizes: tuple[int, ...], a_ids: tuple[np.ndarray, ...], b_ids: tuple[np.ndarray, ...]) -> list[tuple]:
        """The fields of documents whose two token sequences cover the same bytes, all at once."""
        w, count = self.windows, len(sizes)
        begin = np.cumsum(sizes) - sizes
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        cuts, a_cuts, b_cuts = shared_starts(a, w.a_size, self.marked[0], b, w.b_size, self.marked[1], begin)
        doc = np.searchsorted(begin, cuts, "right") - 1
        places = w.places(a, a_cuts, b, b_cuts)
        n_groups = np.bincount(doc, w.n_groups[places], count).astype(np.int64).tolist()
        n_links = np.bincount(doc, w.n_links[places], count).astype(np.int64).tolist()
        texts = list(map(w.texts.__getitem__, places.tolist()))
        text_at = [0, *np.cumsum(np.bincount(doc, minlength=count)).tolist()]

        seen, often = np.unique(doc << 32 | places, return_counts=True)
        window, of = seen & 0xFFFFFFFF, seen >> 32
        n_pairs = w.n_pairs[window]
        at = _ranges(w.first_pair[window], n_pairs)
        held, back = np.unique(np.repeat(of, n_pairs) << 32 | w.pairs[at], return_inverse=True)
        times = np.bincount(back, w.times[at] * np.repeat(often, n_pairs)).astype(np.int64)
        pair, of = held & 0xFFFFFFFF, held >> 32
        self.held = np.concatenate([self.held, np.zeros(len(w.pair_place) - len(self.held), np.int64)])
        self.held += np.bincount(pair, minlength=len(self.held))
        pair_at = np.searchsorted(of, np.arange(count + 1))

        def fields(i: int) -> tuple:
            groups = ";".join(texts[text_at[i] : text_at[i + 1]])
            one = slice(pair_at[i], pair_at[i + 1])
            steps = np.diff(pair[one], prepend=0).astype(np.int32)  # small numbers, for the compression
            digest = hashlib.sha256(groups.encode()).hexdigest() if self.digest else groups
            return len(a_ids[i]), len(b_ids[i]), n_groups[i], n_links[i], digest, steps.tobytes(), times[one].tobytes()

        return [fields(i) for i in range(count)]


def _sums(docs: pa.Table, found: pa.Table) -> pa.Table:
    n, best = found["n"].to_numpy(), found["best"].to_numpy()
    out = []
    for steps, often in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, times = np.cumsum(np.frombuffer(steps, np.int32)), np.frombuffer(often, np.int64)
        out.append((int(times[n[at] == best[at]].sum()), int(times @ n[at])) if len(at) else (0, 0))
    n_best, count_sum = zip(*out, strict=True)
    given = ("doc_id", "text_key", "n_a", "n_b", "n_groups", "n_links")
    sums = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table({name: docs[name] for name in given} | sums | {"groups": docs["groups"]})


def align(docs: DataFrame, byte_path: str, piece_path: str, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, text_key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    Side A are the ids of the byte-level tokenizer file for a space and the text, side B those of the
    sentencepiece model for the text; both files are read here and sent to the tasks. Tokens are grouped
    between the bytes at which tokens of both sides end: ``groups`` lists them as ``a1,a2|b1;a3|b2,b3``, with
    ``digest`` as its sha256. Every A token of a group is linked to every B token of it. An id pair counts in how many
    documents of the table it is linked; ``n_best`` links have the highest count of their A id,
    ``count_sum`` adds the counts over the links.

    Texts that are null or empty, and those that a tokenizer alters, have no tokens: zeros and ''.
    Repeated rows and documents without an id count each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    spec, model = Path(byte_path).read_text(encoding="utf-8"), Path(piece_path).read_bytes()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    result = "doc_id long, text_key long, n_a long, n_b long, n_groups long, n_links long"
    with scratch(spark, "alignment") as written:
        packs = written(
            packed(
                rows,
                lambda: _Aligned(spec, model, digest),
                f"key long, n long, {result}, groups string, places binary, times binary",
            ),
            "documents",
        )
        counts = key_totals(packs).withColumn("a", F.shiftright("key", 32))
        # one row per id of the vocabulary at most
        best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("best")))
        fields = ["doc_id", "text_key", "n_a", "n_b", "n_groups", "n_links", "groups", "places", "times"]
        values = counts.join(best, "a").select("key", "n", "best")
        summed = looked_up(packs, fields, values, _sums, f"{result}, n_best long, count_sum long, groups string")
        return stored(summed)
