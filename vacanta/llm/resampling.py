"""Importance resampling towards a target: scored weights, and the best part by weighted median-of-medians selection.

Features are runs of words, hashed into buckets by crc32. Two arrays of counts, of the corpus and of the target, give
each bucket a gain; a document's weight is the sum of the gains of its features, and a fixed noise by doc_id is added
(Gumbel noise, so that taking the highest scores draws without replacement in proportion to the weights).

The draw is exact. In each round every partition gives the medians of its remaining scores, a bounded chunk at a time, and
how many they stand for; the weighted median of these medians is the next pivot. At least a quarter of the remaining
scores lies on either side of it, so each round discards a guaranteed fraction, until the pivot is the cutoff itself.
Ties at the cutoff score are cut by doc_id in the same way. Only the winners are sorted.

Null and empty texts have no features and weigh 0. doc_id is an integer; rows without it draw noise as the empty text
would and come last among equals. Repeated rows are rows of their own; where the cutoff falls among repeated rows, as
many of them are drawn as there is room for. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.shared import discard, ship, written
from vacanta.llm.text import LETTERS, pieces, spaced, spans
from vacanta.tables import numbered

BUCKETS = 10_000
#: Words of a feature at most.
RUN = 1
SEED = 2024
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
#: Scores that one median stands for: 8 bytes each in a task.
CHUNK = 1 << 20
#: Longer features are hashed one by one.
LONG = 64


def byte_table() -> np.ndarray:
    """crc32 of each byte value, by the reflected polynomial."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> np.uint32(1)) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


BYTE_CRC = byte_table()


def crc32(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of data[first:last], of all of them at once."""
    length = last - first
    out = np.zeros(len(first), np.uint32)
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = zlib.crc32(data[first[i] : last[i]])
    short = np.flatnonzero(length <= LONG)
    short = short[np.argsort(length[short].astype(np.uint8), kind="stable")[::-1]]
    begin, size = first[short], length[short]
    value = np.full(len(short), 0xFFFFFFFF, np.uint32)
    going = len(short)
    for j in range(int(size[0]) if going else 0):
        going = int(np.searchsorted(-size[:going], -j, "left"))
        value[:going] = BYTE_CRC[(value[:going] ^ data[begin[:going] + j]) & np.uint32(255)] ^ (value[:going] >> np.uint32(8))
    out[short] = value ^ np.uint32(0xFFFFFFFF)
    return out


def features(column: pa.Array, run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket and the document of each feature, and the number of words of each document."""
    data, first, last, of = spans(column, LETTERS, True)
    n = np.diff(of)
    if run > 1:
        data, first, last = spaced(data, first, last)
    doc = np.repeat(np.arange(len(n)), n)
    found = []
    for r in range(1, run + 1):
        whole = np.flatnonzero(doc[: len(doc) - r + 1] == doc[r - 1 :])
        found.append((crc32(data, first[whole], last[whole + r - 1]) % np.uint32(buckets), doc[whole]))
    return np.concatenate([b for b, _ in found]), np.concatenate([d for _, d in found]), n


def bucket_counts(texts: DataFrame, text: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket: a task adds up its own, and one row for each bucket is gathered."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in pieces(batches, text):
            total += np.bincount(features(b.column(text), run, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    ship(texts.sparkSession)
    rows = texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of how much likelier each bucket is in the target, rounded down; one is added to each count."""
    more = len(corpus)
    all_corpus, all_target = float(corpus.sum() + more), float(target.sum() + more)
    return np.array([math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target))) for s, t in zip(map(float, corpus), map(float, target), strict=True)], np.int64)


def noise(doc_id: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", run: int = RUN, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            bucket, doc, n = features(b.column("text"), run, len(held.value))
            count = np.bincount(doc, minlength=len(n))
            weight = np.zeros(len(n), np.int64)
            np.add.at(weight, doc, held.value[bucket])
            drawn = np.fromiter((noise(x, seed) for x in b.column("name").to_pylist()), np.int64, len(n))
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, (n, count, weight, weight + drawn))], ["id", "n_words", "n_features", "weight", "score"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text"))
    return rows.mapInArrow(score, "id long, n_words long, n_features long, weight long, score long").withColumnRenamed("id", doc_id)


def middle(values: np.ndarray) -> int:
    return int(np.partition(values, len(values) // 2)[len(values) // 2])


def sides(values: np.ndarray, pivot: int | None) -> list[tuple[int, int, int]]:
    """(side, count, median) of a chunk: 1 above the pivot, 0 equal to it, -1 below; without a pivot all are above."""
    parts = [(1, values)] if pivot is None else [(1, values[values > pivot]), (0, values[values == pivot]), (-1, values[values < pivot])]
    return [(side, len(x), middle(x)) for side, x in parts if len(x)]


def round_of(values: DataFrame, low: int | None, high: int | None, pivot: int | None, chunk: int) -> list[tuple[int, int, int]]:
    """What the partitions say of their values between low and high: three rows at most for each chunk."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, out = [], 0, []
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            x = x if low is None else x[x > low]
            x = x if high is None else x[x < high]
            for i in range(0, len(x), chunk):
                held.append(x[i : i + chunk])
                size += len(held[-1])
                if size >= chunk:
                    out += sides(np.concatenate(held), pivot)
                    held, size = [], 0
        if size:
            out += sides(np.concatenate(held), pivot)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["side", "n", "median"])

    return [tuple(r) for r in values.mapInArrow(read, "side long, n long, median long").collect()]


def weighted_median(parts: list[tuple[int, int]]) -> int:
    """Of (count, median): the least median that, with those below it, stands for half of all."""
    parts = sorted(parts, key=lambda p: p[1])
    total, so_far = sum(n for n, _ in parts), 0
    for n, median in parts:
        so_far += n
        if 2 * so_far >= total:
            return median
    raise ValueError("no values")


def cutoff(values: DataFrame, k: int, chunk: int = CHUNK) -> tuple[int, int]:
    """The k-th largest value of a table of one long column without nulls, and how many are larger. 1 <= k <= its rows.

    What is left is written anew whenever it is an eighth of what was written last.
    """
    table, rows = written(values.toDF("x"), "keys"), None
    low = high = pivot = None
    above = 0
    while True:
        parts = round_of(table, low, high, pivot, chunk)
        n = {side: sum(c for s, c, _ in parts if s == side) for side in (1, 0, -1)}
        if pivot is not None and n[1] < k - above <= n[1] + n[0]:
            discard(table)
            return pivot, above + n[1]
        if pivot is None or k - above <= n[1]:
            side, low = 1, pivot
        else:
            side, high = -1, pivot
            above += n[1] + n[0]
        if rows is None:
            rows = n[1]
        elif n[side] * 8 <= rows:
            inside = F.lit(True)
            if low is not None:
                inside &= F.col("x") > low
            if high is not None:
                inside &= F.col("x") < high
            left = written(table.filter(inside), "keys")
            discard(table)
            table, rows = left, n[side]
        pivot = weighted_median([(c, m) for s, c, m in parts if s == side])


def drawn(scores: DataFrame, eligible, k: int, doc_id: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """scores (a written table) with rank, from 1, for the k eligible rows of highest score, ties to the smaller doc_id; others null."""
    if k <= 0:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    some = scores.filter(eligible)
    score, above = cutoff(some.select("score"), k, chunk)
    # Descending in this key is ascending in doc_id, with nulls last.
    last = F.coalesce(F.bitwise_not(doc_id), F.lit(1 - (1 << 63)))
    key, _ = cutoff(some.filter(F.col("score") == score).select(last), k - above, chunk)
    wins = eligible & ((F.col("score") > score) | (F.col("score") == score) & (last >= key))
    # A row that is repeated at the cutoff key may come in once too often: it is not drawn.
    placed = numbered(scores.filter(wins), [F.desc("score"), F.asc_nulls_last(doc_id), F.asc("n_features")], "rank")
    ranked = placed.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return ranked.unionByName(scores.filter(~F.coalesce(wins, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """Each document with n_words, n_features, weight, score and rank: floor(percent * N / 100) of the N long enough are drawn."""
    gain = gains(bucket_counts(docs, text, run, buckets), bucket_counts(target, target_text, run, buckets))
    scores = written(scored(docs, gain, doc_id, text, run, seed), "scores")
    eligible = F.col("n_words") >= least_words
    return drawn(scores, eligible, percent * scores.filter(eligible).count() // 100, doc_id, chunk)
