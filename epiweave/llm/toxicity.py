"""Toxicity categories by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epiweave.llm.common import small_batches, text_key

#: Labelled rows that are learnt from, the first by a hash of their id.
SAMPLE_ROWS = 4000
#: Words that are features: those found in at least MIN_DOCS sampled texts, the most telling ones.
MIN_DOCS = 4
VOCABULARY = 4000
FOLDS = 3
_WORDS = re.compile(r"\w+")


def distinct_words(text: str | None) -> set[str]:
    return set(_WORDS.findall(text.lower())) if text else set()


def _probability(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


@dataclass
class Linear:
    """Logistic model of words held and of the probabilities of earlier categories."""

    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return _probability(rows.dot(self.words) + earlier @ self.earlier + self.bias)


class Rows:
    """Word sets as index lists."""

    def __init__(self, found: list[np.ndarray], size: int):
        self.size, self.found = size, found
        self.index = np.concatenate([np.empty(0, np.int64), *found])
        self.owner = np.repeat(np.arange(len(found)), [len(f) for f in found])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.index], len(self.found))

    def gather(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, errors[self.owner], self.size)

    def take(self, at: np.ndarray) -> Rows:
        return Rows([self.found[i] for i in at], self.size)


def fit(rows: Rows, earlier: np.ndarray, labels: np.ndarray, penalty: float = 2e-4, rounds: int = 150) -> Linear:
    """Accelerated proximal gradient steps; the penalty on word weights leaves out words that tell nothing."""
    n, k = len(labels), earlier.shape[1]
    w = v = np.zeros(rows.size + k + 1)
    momentum = 1.0
    base = np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))
    # Each weight has a step of its own, from how often its feature is met and beside how many others.
    beside = np.bincount(rows.owner, minlength=n) + k + 1.0
    curvature = np.concatenate([rows.gather(beside), np.full(k + 1, beside.sum())]) / (4 * max(1, n))
    step = 1 / np.maximum(curvature, 1e-9)
    limit = np.where(np.arange(len(w)) < rows.size, step * penalty, 0)
    for _ in range(rounds):
        score = rows.dot(v[: rows.size]) + earlier @ v[rows.size : -1] + v[-1] + base
        error = (_probability(score) - labels) / max(1, n)
        slope = np.concatenate([rows.gather(error), earlier.T @ error, [error.sum()]])
        moved = v - step * slope
        new = np.sign(moved) * np.maximum(np.abs(moved) - limit, 0)
        after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        v = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return Linear(w[: rows.size], w[rows.size : -1], float(w[-1] + base))


@dataclass
class Chain:
    """Models of the categories in order; each is given the probabilities of those before it."""

    categories: list[str]
    place: dict[str, int]
    models: list[Linear]
    #: Probability from which a text counts as of a category.
    cutoffs: list[float]

    def predict(self, words: list[set[str]]) -> np.ndarray:
        rows = Rows([self._indexes(w) for w in words], len(self.place))
        found = np.empty((len(words), 0))
        for model in self.models:
            found = np.column_stack([found, model.predict(rows, found)])
        return found

    def _indexes(self, words: set[str]) -> np.ndarray:
        known = sorted(self.place[w] for w in words & self.place.keys())
        return np.array(known, np.int64)


def train(words: list[set[str]], labels: np.ndarray, categories: list[str], seed: int = 7) -> Chain:
    """The chain learnt from word sets and 0/1 labels (rows, categories).

    A later model is trained with out-of-fold probabilities of the earlier categories, which are as
    uncertain as those it will be given; at prediction they come from models of all rows. The cutoffs
    are chosen on the out-of-fold probabilities too.
    """
    place = vocabulary(words, labels)
    chain = Chain(categories, place, [], [])
    rows = Rows([chain._indexes(w) for w in words], len(place))
    fold = np.random.default_rng(seed).permutation(len(words)) % FOLDS
    earlier = np.empty((len(words), 0))
    for column in labels.T.astype(float):
        outside = np.zeros(len(words))
        for k in range(FOLDS):
            learn, judge = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            if len(learn) and len(judge):
                model = fit(rows.take(learn), earlier[learn], column[learn])
                outside[judge] = model.predict(rows.take(judge), earlier[judge])
        chain.models.append(fit(rows, earlier, column))
        chain.cutoffs.append(cutoff(outside, column))
        earlier = np.column_stack([earlier, outside])
    return chain


def cutoff(probabilities: np.ndarray, labels: np.ndarray) -> float:
    """The probability that parts the labels with the best F1, halfway to the next lower one; 0.5 with one kind of label."""
    if not 0 < labels.sum() < len(labels):
        return 0.5
    order = np.argsort(-probabilities, kind="stable")
    sorted_p, right = probabilities[order], np.cumsum(labels[order])
    f1 = 2 * right / (np.arange(1, len(labels) + 1) + labels.sum())
    # Equal probabilities cannot be parted.
    f1[:-1][sorted_p[:-1] == sorted_p[1:]] = -1
    best = int(f1.argmax())
    return float((sorted_p[best] + sorted_p[min(best + 1, len(labels) - 1)]) / 2)


def vocabulary(words: list[set[str]], labels: np.ndarray) -> dict[str, int]:
    """Words of enough texts that tell most about some category, by their chi-square."""
    held = Counter(w for s in words for w in s)
    common = sorted(w for w, n in held.items() if n >= MIN_DOCS)
    n, best = max(1, len(words)), np.zeros(len(common))
    total = np.array([held[w] for w in common], float)
    for column in labels.T:
        within = Counter(w for s, y in zip(words, column, strict=True) if y for w in s)
        share = column.mean() if len(column) else 0.0
        seen = np.array([within[w] for w in common], float)
        best = np.maximum(best, (seen - total * share) ** 2 / np.maximum(total * share * (1 - share) * (1 - total / n), 1e-9))
    top = np.argsort(-best, kind="stable")[:VOCABULARY]
    return {common[i]: k for k, i in enumerate(sorted(top))}


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE_ROWS):
    """(word sets, labels) of a bounded sample of labelled documents.

    Labels are sampled first, by a hash of their id, so only that many texts are looked up; the
    sample is broadcast, its size is ``rows``. Labels with a null id or category are not learnt from,
    nor are contradicting labels of one id told apart: each pairs with each text of that id.
    """
    full = labels.select(F.col("doc_id").alias("_id"), *(F.col(c).cast("int") for c in categories)).na.drop()
    sample = full.orderBy(F.xxhash64(F.lit(7), "_id"), *categories).limit(rows)

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(distinct_words(t)))

    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    joined = joined.select("doc_id", text_key().alias("key"), *categories, words("text").alias("words"))
    found = sorted(joined.collect(), key=lambda r: (r.doc_id, r.key, *(r[c] for c in categories)))
    return [set(r.words) for r in found], np.array([[r[c] for c in categories] for r in found]).reshape(-1, len(categories))


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents with ``toxicity``, a struct of one probability per category, beside their own columns.

    A column of the documents that is itself named ``toxicity`` is replaced.

    Every whole text is read. Null and empty texts hold no words and get what the models give
    those; with no labelled documents at all every probability is that of no information.
    Repeated rows are judged alike.
    """
    small_batches(docs.sparkSession)
    chain = train(*labelled_sample(docs, labels, categories, rows), categories)
    return docs.withColumn("toxicity", toxicity_column(chain, "text"))


def toxic_documents(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """As ``toxicity``, with ``found`` beside it: the categories whose probability reaches their cutoff, in order.

    A column of the documents that is itself named ``found`` is replaced.
    """
    small_batches(docs.sparkSession)
    chain = train(*labelled_sample(docs, labels, categories, rows), categories)
    scored = docs.withColumn("toxicity", toxicity_column(chain, "text"))
    reached = [
        F.when(F.col("toxicity").getField(c) >= cut, F.lit(c)) for c, cut in zip(categories, chain.cutoffs, strict=True)
    ]
    return scored.withColumn("found", F.array_compact(F.array(*reached)))


def toxicity_column(chain: Chain, text: str) -> Column:
    @F.pandas_udf(", ".join(f"`{c}` double" for c in chain.categories))
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(chain.predict([distinct_words(t) for t in texts]), columns=chain.categories)

    return predict(F.col(text))
