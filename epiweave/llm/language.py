"""Language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiweave.llm.common import small_batches, text_key, unused

UNDETERMINED = "und"
HIDDEN = 8
#: Bytes the network reads at a stretch; every byte of a text is in one stretch.
STRETCH = 128
#: Stretches read side by side; bounds the memory of a task.
ROWS = 1024
#: Input partitions whose first documents of a language are put together before those of all are.
PARTITIONS_AT_ONCE = 256
# Bounds of the training sample.
DOCS_PER_LANGUAGE = 400
WINDOWS_PER_DOC = 2
WINDOW_CHARS = 64


def _gate(x: np.ndarray) -> np.ndarray:
    """Hard sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


class Direction:
    """One gated recurrent layer: byte tables for update, reset and new state, and their recurrences."""

    def __init__(self, rng: np.random.Generator):
        self.gates = rng.normal(0, 0.3, (256, 2 * HIDDEN)).astype(np.float32)
        self.new = rng.normal(0, 0.3, (256, HIDDEN)).astype(np.float32)
        self.u_gates = rng.normal(0, 0.3, (HIDDEN, 2 * HIDDEN)).astype(np.float32)
        self.u_new = rng.normal(0, 0.3, (HIDDEN, HIDDEN)).astype(np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.gates, self.new, self.u_gates, self.u_new]

    def forward(self, steps: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after each byte of ``steps`` (time, rows), zero where ``mask`` says that there is none.

        With ``keep`` also what training needs.
        """
        h = np.zeros((steps.shape[1], HIDDEN), np.float32)
        states = np.empty((*steps.shape, HIDDEN), np.float32)
        tape = []
        for t, byte in enumerate(steps):
            zr = self.gates.take(byte, axis=0)
            zr += h @ self.u_gates
            _gate(zr)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            back = h @ self.u_new
            n = self.new.take(byte, axis=0)
            n += r * back
            if keep:
                tape.append((h, zr, back, n.copy()))
            np.clip(n, -1, 1, out=n)
            h = n + z * (h - n)
            if not mask[t].all():
                h *= mask[t][:, None]
            states[t] = h
        return states, tape

    def backward(self, steps: np.ndarray, mask: np.ndarray, tape: list, outer: np.ndarray) -> list[np.ndarray]:
        """Gradients by backpropagation through time of the gradients ``outer`` of all states."""
        grads = [np.zeros_like(p) for p in self.parameters()]
        dh = np.zeros_like(outer[0])
        for t in range(len(steps) - 1, -1, -1):
            h, zr, back, pre = tape[t]
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.clip(pre, -1, 1)
            dh = (dh + outer[t]) * mask[t][:, None]
            d_new = dh * (1 - z) * (np.abs(pre) < 1)
            d_zr = np.concatenate([dh * (h - n), d_new * back], axis=1) * 0.25 * ((zr > 0) & (zr < 1))
            d_back = d_new * r
            np.add.at(grads[0], steps[t], d_zr)
            np.add.at(grads[1], steps[t], d_new)
            grads[2] += h.T @ d_zr
            grads[3] += h.T @ d_back
            dh = dh * z + d_zr @ self.u_gates.T + d_back @ self.u_new.T
        return grads


@dataclass
class Network:
    """Two directions and the layer that labels every position from both states."""

    languages: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        shape = (2 * HIDDEN, len(languages))
        out = rng.normal(0, 0.3, shape).astype(np.float32)
        return cls(languages, Direction(rng), Direction(rng), out, np.zeros(len(languages), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.back.parameters(), self.out, self.bias]

    def positions(self, steps: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Language probabilities at every position of ``steps`` (time, rows) that ``mask`` has."""
        one, tape_one = self.ahead.forward(steps, mask, keep)
        two, tape_two = self.back.forward(steps[::-1], mask[::-1], keep)
        states = np.concatenate([one, two[::-1]], axis=2)
        scores = states @ self.out
        scores += self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        return scores, (states, tape_one, tape_two)

    def gradients(self, steps: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients."""
        probabilities, (states, tape_one, tape_two) = self.positions(steps, mask, True)
        count = max(1, mask.sum())
        chosen = np.take_along_axis(probabilities, np.broadcast_to(labels[None, :, None], (*steps.shape, 1)), 2)
        loss = -(np.log(chosen[..., 0] + 1e-9) * mask).sum() / count
        d = probabilities.copy()
        d[:, np.arange(len(labels)), labels] -= 1
        d *= mask[..., None] / count
        flat = d.reshape(-1, d.shape[2])
        d_states = (flat @ self.out.T).reshape(states.shape)
        grads = self.ahead.backward(steps, mask, tape_one, d_states[..., :HIDDEN])
        grads += self.back.backward(steps[::-1], mask[::-1], tape_two, d_states[::-1, :, HIDDEN:])
        return loss, [*grads, states.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)]


def _matrix(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and mask as (time, rows)."""
    lengths = np.array([len(p) for p in pieces])
    joined = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
    mask = np.arange(width)[:, None] < lengths[None, :]
    return np.ascontiguousarray(joined.reshape(len(pieces), width).T), mask


def train(samples: list[tuple[str, str]], steps: int = 250, rows: int = 96, seed: int = 6) -> Network | None:
    """A network learnt with Adam from (text window, language) pairs; None without any."""
    languages = sorted({language for _, language in samples})
    if not languages:
        return None
    network = Network.new(languages, seed)
    rng = np.random.default_rng(seed)
    by_language = [[t.encode()[:STRETCH] for t, x in samples if x == language] for language in languages]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in network.parameters()]
    for step in range(1, steps + 1):
        labels = rng.integers(len(languages), size=rows)
        pieces = [by_language[x][rng.integers(len(by_language[x]))] for x in labels]
        matrix, mask = _matrix(pieces, max(1, max(map(len, pieces))))
        _, grads = network.gradients(matrix, mask.astype(np.float32), labels)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(network.parameters(), grads, moments, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return network


def identify(network: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and its probability, pooled over every position of every text."""
    pooled = np.zeros((len(texts), len(network.languages)))
    pieces: list[bytes] = []
    owners: list[int] = []

    def flush() -> None:
        if pieces:
            matrix, mask = _matrix(pieces, STRETCH)
            probabilities, _ = network.positions(matrix, mask)
            np.add.at(pooled, owners, np.einsum("trc,tr->rc", probabilities, mask, dtype=np.float64))
            pieces.clear()
            owners.clear()

    judged = [t is not None and any(map(str.isalpha, t)) for t in texts]
    for i, (text, known) in enumerate(zip(texts, judged, strict=True)):
        if known:
            data = text.encode()
            for start in range(0, len(data), STRETCH):
                pieces.append(data[start : start + STRETCH])
                owners.append(i)
                if len(pieces) == ROWS:
                    flush()
    flush()
    out = []
    for known, p in zip(judged, pooled, strict=True):
        best = int(p.argmax())
        out.append((network.languages[best], min(1.0, float(p[best] / p.sum()))) if known else (UNDETERMINED, 0.0))
    return out


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is never learnt from: crc32 of its id as text is 0 modulo ``folds``, or it has none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(True))


def training_windows(docs: DataFrame, seed: int = 6) -> list[tuple[str, str]]:
    """Text windows at seeded places with their language, from a bounded sample of the documents to learn from.

    At most DOCS_PER_LANGUAGE documents of a language, the first by a hash, and WINDOWS_PER_DOC
    windows of WINDOW_CHARS characters from anywhere in each. They are found among those of each task, then of
    PARTITIONS_AT_ONCE tasks, then of all, so no task is sent the rows of one language from all tasks.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", text_key())
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & (F.char_length("text") > 0)).select("lang", "text", key.alias("key"))
    room = F.greatest(F.char_length("text") - WINDOW_CHARS + 1, F.lit(1))
    windows = [
        F.substring(F.col("text"), (F.pmod(F.xxhash64("key", F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW_CHARS))
        for i in range(WINDOWS_PER_DOC)
    ]
    group = F.floor(F.spark_partition_id() / PARTITIONS_AT_ONCE).alias("group")
    taken = rows.select("lang", "key", F.array(*windows).alias("windows"), group)
    for of in (["lang", "group"], ["lang"]):
        first = F.row_number().over(Window.partitionBy(*of).orderBy("key", F.col("windows")[0], F.col("windows")[1]))
        taken = taken.withColumn("place", first).where(F.col("place") <= DOCS_PER_LANGUAGE)
    return [(w, r.lang) for r in taken.orderBy("lang", "place").collect() for w in r.windows]


def language_column(network: Network | None, text: str) -> Column:
    """Struct (lang_pred, score) of a text, every byte of it read."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = identify(network, list(texts)) if network else [(UNDETERMINED, 0.0)] * len(texts)
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    return predict(F.col(text))


def identify_languages(docs: DataFrame, name: str = "language") -> DataFrame:
    """The documents with ``language`` (lang_pred, score) beside their own columns; one of that ``name`` is replaced.

    The network is trained from the text and lang of documents that are not held out; lang,
    source and doc_id are no inputs of a prediction. Null texts and texts without a letter are
    ``und`` with score 0, as is everything where no document can be learnt from. Repeated
    rows are judged alike.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(name, language_column(train(training_windows(docs)), "text"))


def identified_documents(docs: DataFrame) -> DataFrame:
    """The documents whose language is determined, whatever the score, with their own columns."""
    name = unused(docs, "_language")
    return identify_languages(docs, name).where(F.col(f"{name}.lang_pred") != UNDETERMINED).drop(name)
