"""Toxicity by subword-bag embeddings.

Every word, lower-cased and marked at both ends, gives its character n-grams (3 to 6 bytes) and itself; each is
hashed to one of the rows of an embedding table. The rows of a text are averaged and go to a linear softmax over
two labels; table and softmax are trained jointly in numpy with Adam. A misspelling that was never seen shares
most n-grams with the word that it comes from.

Training takes at most `most` rows of each label (a parameter), whose n-gram counts come to the driver; a quarter of
them is kept back to set the bias, where the two labels err least at CLEAN_SHARE clean texts. Scoring
is one pass without shuffle: as the model is linear in the average, each n-gram counts with one number, the
difference of the two logits. Texts without words (null, empty) score 0, and so does every
document if there are no rows of one label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.samples import labelled
from vacanta.llm.shared import ship
from vacanta.llm.text import BYTE, LETTERS, WEIGHT, Words, mix, pieces, words

BITS = 18
DIM = 4
SIZES = (3, 4, 5, 6)
MOST = (3000, 1200)
EPOCHS = 8
#: The share of clean texts that the bias is set for.
CLEAN_SHARE = 0.9
RATE = 0.05
#: Added to the root of the squared gradients: n-grams of a few texts then move little.
FLOOR = 1e-5


def grams(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words: rows of their n-grams, where each word's begin (n + 1), and for every word its distinct one."""
    _, one, which = np.unique(w.hash, return_index=True, return_inverse=True)
    length = w.last[one] - w.first[one]
    begin = np.cumsum(length + 2) - (length + 2)
    data = np.full(int((length + 2).sum()), ord(">"), np.uint8)
    data[begin] = ord("<")
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    data[np.repeat(begin + 1, length) + place] = w.data[np.repeat(w.first[one], length) + place]
    end = np.repeat(begin + length + 2, length + 2)
    word = np.repeat(np.arange(len(one)), length + 2)
    rows, owner = [(mix(w.hash[one]) >> np.uint64(64 - BITS)).astype(np.int32)], [np.arange(len(one))]
    value = BYTE[data]
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for j in range(n):
            h += value[j : j + len(h)] * WEIGHT[j]
        ok = np.arange(len(h)) + n <= end[: len(h)]
        rows.append((mix(h[ok]) >> np.uint64(64 - BITS)).astype(np.int32))
        owner.append(word[: len(h)][ok])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.searchsorted(owner[order], np.arange(len(one) + 1)), which


@dataclass
class Model:
    value: np.ndarray  # of each n-gram, the difference of logits
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        w = words(column, LETTERS, True)
        best = np.full(len(column), -np.inf)
        if len(w.hash):
            rows, at, which = grams(w)
            total = np.concatenate([[0], np.cumsum(self.value[rows], dtype=float)])
            of_word, size = (total[at[1:]] - total[at[:-1]])[which], np.diff(at)[which]
            full = np.diff(w.of) > 0
            begin = w.of[:-1][full]
            best[full] = np.add.reduceat(of_word, begin) / np.add.reduceat(size, begin) + self.bias
        return np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(best, -30, 30))), 0.0)


def bags(docs: DataFrame) -> DataFrame:
    """y and, packed, the n-gram rows of each text and how often each is there."""

    def run(batches):
        for b in pieces(batches, "text", 1 << 20):
            w = words(b.column("text"), LETTERS, True)
            out = [(b"", b"")] * b.num_rows
            if len(w.hash):
                rows, at, which = grams(w)
                for d in np.flatnonzero(np.diff(w.of)):
                    word, times = np.unique(which[w.of[d] : w.of[d + 1]], return_counts=True)
                    size = np.diff(at)[word]
                    own = rows[np.repeat(at[word], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]
                    one, of = np.unique(own, return_inverse=True)
                    out[d] = (one.astype("<i4").tobytes(), np.bincount(of, np.repeat(times, size)).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *(pa.array([x[i] for x in out], pa.binary()) for i in range(2))], ["doc_id", "y", "rows", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "y", "text").mapInArrow(run, f"doc_id {kind}, y int, rows binary, counts binary")


def fit(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 64, rate: float = RATE, seed: int = 3) -> Model | None:
    """examples: label, rows, counts."""
    examples = [e for e in examples if len(e[1])]
    y = np.array([e[0] for e in examples])
    if not len(y) or y.min() == y.max():
        return None
    rnd = np.random.default_rng(seed)
    order = rnd.permutation(len(y))
    held = [examples[j] for j in order[: len(y) // 4]]
    examples = [examples[j] for j in order[len(y) // 4 :]]
    y = np.array([e[0] for e in examples])
    if y.min() == y.max():
        return None
    table = rnd.normal(0, 0.1, (1 << BITS, DIM))
    soft = rnd.normal(0, 0.5, (DIM, 2))
    bias = np.zeros(2)
    state = {name: [np.zeros_like(x), np.zeros_like(x)] for name, x in (("table", table), ("soft", soft), ("bias", bias))}
    share = len(y) / 2 / np.array([(y == 0).sum(), (y == 1).sum()])
    t = 0
    for _ in range(epochs):
        order = rnd.permutation(len(y))
        for i in range(0, len(order), batch):
            part = [examples[j] for j in order[i : i + batch]]
            sizes = np.array([len(e[1]) for e in part])
            label = np.array([e[0] for e in part])
            rows = np.concatenate([e[1] for e in part])
            part_of = np.concatenate([e[2] / e[2].sum() for e in part])
            doc = np.repeat(np.arange(len(part)), sizes)
            touched, of = np.unique(rows, return_inverse=True)
            mean = np.add.reduceat(table[rows] * part_of[:, None], np.cumsum(sizes) - sizes)
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = p
            wrong[np.arange(len(label)), label] -= 1
            wrong *= share[label][:, None] / len(part)
            back = wrong @ soft.T
            g = np.column_stack([np.bincount(of, back[doc, k] * part_of, len(touched)) for k in range(DIM)])
            t += 1
            for name, x, grad, at in (("table", table, g, touched), ("soft", soft, mean.T @ wrong, slice(None)), ("bias", bias, wrong.sum(0), slice(None))):
                m, v = state[name]
                m[at] = 0.9 * m[at] + 0.1 * grad
                v[at] = 0.99 * v[at] + 0.01 * grad * grad
                x[at] -= rate * (m[at] / (1 - 0.9**t)) / (np.sqrt(v[at] / (1 - 0.99**t)) + FLOOR)
    value = table @ (soft[:, 1] - soft[:, 0])
    bias = calibrated([(e[0], float(value[e[1]] @ (e[2] / e[2].sum()))) for e in held], float(bias[1] - bias[0]))
    return Model(value.astype(np.float32), bias)


def calibrated(held: list[tuple[int, float]], bias: float) -> float:
    """The bias that puts the cut where least of the held rows err, in the middle of the widest such gap."""
    y, x = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    if not len(y) or y.min() == y.max():
        return bias
    order = np.argsort(x, kind="stable")
    y, x = y[order], x[order]
    missed = (1 - CLEAN_SHARE) * np.concatenate([[0], np.cumsum(y == 1)]) / (y == 1).sum()
    wrong = CLEAN_SHARE * (1 - np.concatenate([[0], np.cumsum(y == 0)]) / (y == 0).sum())
    edge = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    best = np.flatnonzero(np.isclose(missed + wrong, (missed + wrong).min()))
    i = best[np.argmax(edge[best + 1] - edge[best])]
    return -float(edge[i] + edge[i + 1]) / 2


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: tuple[int, int] = MOST) -> Model | None:
    ship(docs.sparkSession)
    got = bags(labelled(docs, labels, label, most)).toArrow().sort_by("doc_id")
    raw = zip(*(got.column(c).to_pylist() for c in ("y", "rows", "counts")), strict=True)
    return fit([(y, np.frombuffer(rows, "<i4"), np.frombuffer(counts, "<i4")) for y, rows, counts in raw])


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, 0 to 1."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in pieces(batches, text):
            s = held.value.score(b.column(text)) if held.value else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(doc_id), pa.array(s)], [doc_id, "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, score double")


def predicted(scores: DataFrame, cut: float = 0.5) -> DataFrame:
    return scores.withColumn("predicted", (F.col("score") >= cut).cast("int"))
