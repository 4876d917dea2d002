"""Quality classifier by Bradley-Terry ranking.

A document has measures of its form (shares of signs, capitals, digits, repeated and distinct words, lengths).
Each measure becomes a piecewise-linear basis over quantiles of the training rows. Preference pairs (a document
of label 1 over one of label 0) give a logistic loss on the difference of their features, whose weights make a
score. The weights come from a bounded sample; the cut is the quantile of the scores of all labelled rows at their
share of label 0, so it doesn't move with the size of the input. Scores are mapped to 0..1 by a
logistic curve that gives 0.7 at the cut.

The weights learn from at most `most` rows of each label (a parameter) and `pairs` pairs. While that leaves no row out,
the cut comes from the same rows; else all rows are scored once more, and the scores of the labelled ones are joined and
counted in Spark, without their texts. Scoring scans whole texts of all rows in one pass without shuffle. Null and empty texts have measures of zero and get a score; with no
rows of one label every document scores 1.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.llm.samples import known, labelled
from vacanta.llm.shared import beside, ship, written
from vacanta.llm.text import NOT_SPACE, pieces, runs, text_bytes, words

CUT_SCORE = 0.7
MOST = (6000, 6000)
PAIRS = 60_000
KNOTS = 8

CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "exclaim": b"!",
    "marks": b"#$%&*@^~+=",
    "bars": b"|<>{}[]\\/_",
    "stops": b".,;:?",
    "line": b"\n",
    "space": b" \t",
    "wide": range(128, 256),
}


def measures(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text."""
    data, at = text_bytes(column)
    w = words(column, NOT_SPACE, True)
    size = np.diff(at).astype(float)
    n = np.diff(w.of).astype(float)
    some, some_words = np.maximum(size, 1), np.maximum(n, 1)

    def sums(x: np.ndarray, where: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[where[1:]] - total[where[:-1]]

    out = []
    for kind in CLASSES.values():
        table = np.zeros(256, bool)
        table[list(kind)] = True
        out.append(sums(table[data], at) / some)
    doc = np.repeat(np.arange(len(n)), np.diff(w.of))
    length = (w.last - w.first).astype(float)
    out += [sums(length, w.of) / some_words, sums(length**2, w.of) / some_words, sums(length > 20, w.of) / some_words, sums(length == 1, w.of) / some_words]
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    out.append(sums(same, w.of) / some_words)
    for k in (1, 2, 4):
        grams = runs(w.hash, k)
        ok = np.arange(len(grams)) + k <= w.ends()[: len(grams)]
        owner, value = doc[: len(grams)][ok], grams[ok]
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        of = np.searchsorted(owner, np.arange(len(n) + 1))
        count = np.diff(of)
        out.append(np.where(count > 0, sums(new, of) / np.maximum(count, 1), 1.0))
        # the share of the most frequent run
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(new)))
        top = np.zeros(len(n))
        np.maximum.at(top, owner[starts], lengths)
        out.append(top / np.maximum(count, 1))
    last = data[w.last - 1] if len(w.hash) else np.zeros(0, np.uint8)
    first = data[w.first] if len(w.hash) else np.zeros(0, np.uint8)
    plain = ((last >= 97) & (last <= 122)) | (last >= 128)
    out += [sums(plain, w.of) / some_words, sums((first >= 65) & (first <= 90), w.of) / some_words]
    out += [np.log1p(size), np.log1p(n)]
    return np.column_stack(out)


def basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """For each measure, how far it is through each of the intervals between its knots, 0 to 1."""
    low, high = knots[:, :-1], knots[:, 1:]
    return np.clip((x[:, :, None] - low) / np.maximum(high - low, 1e-9), 0, 1).reshape(len(x), -1)


@dataclass
class Ranker:
    knots: np.ndarray
    weight: np.ndarray
    cut: float

    def value(self, x: np.ndarray) -> np.ndarray:
        return basis(x, self.knots) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        value = self.value(x) - self.cut
        return 1 / (1 + np.exp(-np.clip(value + np.log(CUT_SCORE / (1 - CUT_SCORE)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 300, seed: int = 7) -> Ranker | None:
    if not len(y) or y.min() == y.max():
        return None
    knots = np.quantile(x, np.linspace(0, 1, KNOTS + 1), axis=0).T
    f = basis(x, knots)
    rnd = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    a, b = rnd.choice(good, pairs), rnd.choice(bad, pairs)
    weight, m, v = np.zeros(f.shape[1]), np.zeros(f.shape[1]), np.zeros(f.shape[1])
    for t in range(1, steps + 1):
        s = f @ weight
        wrong = 1 / (1 + np.exp(np.clip(s[a] - s[b], -30, 30)))
        # the gradient of the mean of log(1 + exp(s_b - s_a)), gathered by document
        by = np.bincount(a, -wrong, len(y)) + np.bincount(b, wrong, len(y))
        g = f.T @ by / pairs + 1e-4 * weight
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weight -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    s = f @ weight
    return Ranker(knots, weight, float(np.quantile(s, (y == 0).mean(), method="midpoint")))


def measured(docs: DataFrame, keep: str) -> DataFrame:
    def run(batches):
        for b in pieces(batches, "text"):
            x = measures(b.column("text"))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(keep), rows], [keep, "x"])

    kind = docs.schema[keep].dataType.simpleString()
    return docs.select(keep, "text").mapInArrow(run, f"`{keep}` {kind}, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: tuple[int, int] = MOST) -> Ranker | None:
    """Weights from at most 12,000 rows by default, whose measures alone (some 30 numbers each) come to the driver; the cut from all."""
    ship(docs.sparkSession)
    got = measured(labelled(docs, labels, label, most), "y").toArrow()
    y = got.column("y").to_numpy()
    if not len(y):
        return None
    x = np.array(got.column("x").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # rows come in any order
    model = fit(x[order], y[order])
    every = known(labels, label)
    n = dict(every.groupBy("y").count().collect())
    if model is None or all(n.get(k, 0) <= most[k] for k in (0, 1)):
        return model
    return replace(model, cut=cut_of(docs, every, model))


def cut_of(docs: DataFrame, every: DataFrame, model: Ranker) -> float:
    """The midpoint quantile of the values of all rows of docs that every (doc_id, y) labels, at their share of label 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held.value.value(measures(b.column("text"))))], ["doc_id", "value"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # Only ids and values are joined, no texts.
    values = written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, value double").join(every, "doc_id").select("y", "value"), "values")
    n, bad = values.agg(F.count(F.lit(1)), F.count_if(F.col("y") == 0)).first()
    place = bad / n * (n - 1)
    low = nth(values, int(place))
    if place == int(place):
        return low
    upto, above = values.agg(F.count_if(F.col("value") <= low), F.min(F.when(F.col("value") > low, F.col("value")))).first()
    return low if upto > int(place) + 1 else (low + above) / 2


def nth(values: DataFrame, k: int, bins: int = 4096) -> float:
    """The value at place k of the ascending order, from 0, by counts of ever smaller bins: `bins` numbers come to the driver at a time."""
    low, high = values.agg(F.min("value"), F.max("value")).first()
    while low < high:
        bin_ = F.least(F.floor((F.col("value") - low) / (high - low) * bins), F.lit(bins - 1))
        got = values.filter(F.col("value").between(low, high)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).orderBy("bin").collect()
        for r in got:
            if k < r["n"]:
                break
            k -= r["n"]
        if (r["low"], r["high"]) == (low, high):
            return low
        low, high = r["low"], r["high"]
    return low


def rated(docs: DataFrame, model: Ranker | None, text: str = "text") -> DataFrame:
    """Whole rows as beside() names them, and their score as v0."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return beside(docs, text, lambda x: [pa.array(held.value.score(measures(x)) if held.value else np.ones(len(x)))], [T.DoubleType()])


def score(docs: DataFrame, model: Ranker | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, 0 to 1."""
    got = rated(docs.select(doc_id, text), model, text)
    return got.select(F.col("c0").alias(doc_id), F.col("v0").alias("score"))
