"""Token counts by greedy longest match, through a linear-time automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epiweave.llm.common import small_batches, text_key

#: Mark before pieces that start a word.
START = "▁"
#: Words whose counts a task keeps.
CACHE = 1 << 18


def load_pieces(path: str) -> list[str]:
    """Pieces of a sentencepiece vocabulary file without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Automaton:
    """Trie of the pieces with failure links and the number of pieces popped on them.

    Where state s has no child for the next character, greedy matching cuts the text it
    stands for into ``popped[s]`` pieces and a rest, which is state ``link[s]``. Each character
    goes down the trie once and each link shortens the rest, so a word takes time linear in
    its length and no piece is ever built. Single characters of pieces count as pieces.
    """

    def __init__(self, pieces: Iterable[str]):
        pieces = [p for p in pieces if p]
        self.child: list[dict[str, int]] = [{}]
        whole = {self._add(piece) for piece in [*pieces, *sorted(set("".join(pieces)))]}
        self.link = [0] * len(self.child)
        self.popped = [0] * len(self.child)
        queue = deque((0, c, s) for c, s in self.child[0].items())
        while queue:
            parent, c, state = queue.popleft()
            if state in whole:
                self.popped[state] = 1
            else:
                rest, popped = self.link[parent], self.popped[parent]
                while c not in self.child[rest]:  # ends at the root, which has every character
                    popped += self.popped[rest]
                    rest = self.link[rest]
                self.link[state], self.popped[state] = self.child[rest][c], popped
            queue.extend((state, d, s) for d, s in self.child[state].items())

    def _add(self, piece: str) -> int:
        state = 0
        for c in piece:
            if c not in self.child[state]:
                self.child[state][c] = len(self.child)
                self.child.append({})
            state = self.child[state][c]
        return state

    def count(self, word: str) -> int:
        """Pieces of a word; a character of no piece counts one token for each of its UTF-8 bytes."""
        child, link, popped = self.child, self.link, self.popped
        total = state = 0
        for c in word:
            while c not in child[state]:
                if state == 0:
                    total += len(c.encode())
                    break
                total += popped[state]
                state = link[state]
            else:
                state = child[state][c]
        while state:
            total += popped[state]
            state = link[state]
        return total


class _Counts(dict):
    """Tokens of a word, kept for a bounded number of short words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        count = self.automaton.count(START + word.decode())
        if len(self) < CACHE and len(word) < 64:
            self[word] = count
        return count


def token_count_column(spark: SparkSession, text: str, pieces: list[str]) -> Column:
    """Struct (n_words, n_tokens) of a text.

    The automaton is built once from the vocabulary, whose size is fixed, and sent to the tasks.
    """
    sent = spark.sparkContext.broadcast(Automaton(pieces))
    counts: list[_Counts] = []

    @F.pandas_udf("n_words long, n_tokens long")
    def count(texts: pd.Series) -> pd.DataFrame:
        if not counts:
            counts.append(_Counts(sent.value))
        of = counts[0].__getitem__
        words = (t.encode().split() if t else [] for t in texts)
        found = [(len(w), sum(map(of, w))) for w in words]
        return pd.DataFrame(found, columns=["n_words", "n_tokens"])

    return count(F.col(text))


def token_counts(docs: DataFrame, pieces: list[str]) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, n_tokens.

    Words lie between spaces and the controls 9 to 13; each is marked as a word's start and cut
    into the longest pieces from left to right. Null, empty and blank texts have 0 of both.
    Repeated rows are counted alike.
    """
    small_batches(docs.sparkSession)
    counted = docs.select(
        "doc_id", text_key().alias("text_key"), token_count_column(docs.sparkSession, "text", pieces).alias("n")
    )
    return counted.select("doc_id", "text_key", "n.n_words", "n.n_tokens")
