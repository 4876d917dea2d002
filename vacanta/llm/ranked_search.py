"""Ranked lexical search by the Best Position Algorithm.

Documents stay where they are. A task takes its documents a chunk at a time and builds, for the terms of the queries, impact
lists (a term's documents by falling impact) and the documents' own entries in them. For each query the lists are read
in step, from the top. A document met for the first time is scored at once by direct access to its entries in all the
query's lists, and those entries count as seen as well. The best position of a list is the last one up to which all are
seen; no document that is still unseen scores more than the sum of the impacts at the best positions. Reading stops
once that sum is strictly below the k-th score so far, which the task carries from chunk to chunk, so that an equal score
with a smaller doc_id is never missed. The k best of each task meet in one window by query.

Queries come in blocks of bounded size, each a search over all documents; the result does not depend on the size.
Queries that are null or have no terms, and empty tables, give no rows. Repeated queries and queries without id are each
answered; repeated documents are ranked each. doc_id is an integer; rows without it come last among equals. Extra
columns are ignored. Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacanta.llm.shared import ship, written
from vacanta.llm.text import LETTERS, pieces, ranges, words

TOP = 20
#: Bytes of query text in one block, ids and ends included: at most as many terms, each 8 bytes on every executor.
BLOCK_BYTES = 1 << 20
#: Entries of impact lists that a task holds at a time, some 60 bytes each.
ENTRIES = 1 << 20
#: Documents of a chunk at most, and how far lists are read in the first step; each further step reads twice as far.
DOCUMENTS, STEP = 1 << 20, 32
# Bits of a packed entry: impact is below 2^20 by its formula, the document's number in its chunk below 2^21.
IMPACT_BITS, DOCUMENT_BITS = 20, 21


@dataclass
class Queries:
    """One block: terms is ascending hashes; query q has term[at[q]:at[q + 1]], each so often as times says."""

    numbers: np.ndarray
    terms: np.ndarray
    term: np.ndarray
    times: np.ndarray
    at: np.ndarray


@dataclass
class Corpus:
    """Documents with a term, terms of all of them, and for each term of the block the weight."""

    documents: int
    length: int
    weight: np.ndarray


def block_of(rows: list[tuple[int, str | None]]) -> Queries:
    w = words(pa.array([x for _, x in rows], pa.string()), LETTERS, True)
    terms, which = np.unique(w.hash, return_inverse=True)
    query = np.repeat(np.arange(len(rows)), np.diff(w.of))
    key, times = np.unique(query * max(1, len(terms)) + which, return_counts=True)
    return Queries(np.array([n for n, _ in rows], np.int64), terms, key % max(1, len(terms)), times, np.searchsorted(key, np.arange(len(rows) + 1) * max(1, len(terms))))


def blocks(items: DataFrame, size: int) -> Iterator[Queries]:
    """All queries (number, text), a bounded part at a time."""
    part, held = [], 0
    for number, x in items.select("number", "text").toLocalIterator():
        part.append((number, x))
        held += 32 + len((x or "").encode())
        if held >= size:
            yield block_of(part)
            part, held = [], 0
    if part:
        yield block_of(part)


def entries(column: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """document, term and count of each term of the block in each text, by document; and the terms of each text with repeats."""
    w = words(column, LETTERS, True)
    n = np.diff(w.of)
    i = np.minimum(np.searchsorted(terms, w.hash), max(0, len(terms) - 1))
    known = terms[i] == w.hash if len(terms) else np.zeros(len(w.hash), bool)
    key, count = np.unique(np.repeat(np.arange(len(n)), n)[known] * max(1, len(terms)) + i[known], return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), count, n


def statistics(docs: DataFrame, block: Queries) -> Corpus:
    """Over all documents. A task adds up its own; one row for each term of the block is gathered."""
    held = docs.sparkSession.sparkContext.broadcast(block.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value) + 2, np.int64)
        for b in pieces(batches, "text"):
            _, term, _, n = entries(b.column("text"), held.value)
            total[:-2] += np.bincount(term, minlength=len(held.value))
            total[-2:] += (int((n > 0).sum()), int(n.sum()))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    total = np.zeros(len(block.terms) + 2, np.int64)
    for r in docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        total[r["term"]] = r["n"]
    held.destroy()
    n = int(total[-2])
    return Corpus(n, int(total[-1]), np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in total[:-2].tolist()], np.int64))


class Best:
    """The k best of each query so far: scores and ids, best first."""

    def __init__(self, n: int, k: int):
        self.k = k
        none = np.zeros(0, np.int64)
        self.rows = [(none, none, none) for _ in range(n)]

    def kth(self, q: int) -> int:
        score = self.rows[q][0]
        return int(score[-1]) if len(score) == self.k else 0

    def add(self, q: int, score: np.ndarray, unnamed: np.ndarray, doc: np.ndarray) -> None:
        """Scores of 0 are none; the ids of documents that have none come last."""
        ok = (score > 0) & (score >= self.kth(q))
        if ok.any():
            s, u, d = (np.concatenate([x, y[ok]]) for x, y in zip(self.rows[q], (score, unnamed, doc), strict=True))
            first = np.lexsort((d, u, -s))[: self.k]
            self.rows[q] = (s[first], u[first], d[first])


class Lists:
    """The impact lists of one chunk, and its documents' own entries."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        self.term, self.impact = term, impact
        self.own = np.searchsorted(doc, np.arange(n_docs + 1))
        order = np.argsort((term << (IMPACT_BITS + DOCUMENT_BITS)) | (((1 << IMPACT_BITS) - 1 - impact) << DOCUMENT_BITS) | doc)
        self.listed, self.listed_impact = doc[order], impact[order]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        self.gain = np.zeros(n_terms, np.int64)
        self.met = np.zeros(n_docs, bool)
        self.seen = np.zeros(len(order), bool)

    def search(self, term: np.ndarray, gain: np.ndarray, q: int, best: Best, unnamed: np.ndarray, doc_id: np.ndarray) -> int:
        """Bring the chunk's documents into the best of query q. Returns how many entries were read in order."""
        some = (self.start[term + 1] > self.start[term]) & (gain > 0)
        term, gain = term[some], gain[some]
        begin, end = self.start[term], self.start[term + 1]
        # The best position of each list: all entries before it are seen.
        reach, depth, step, read = begin.copy(), 0, STEP, 0
        bound = int((gain * self.listed_impact[begin]).sum())
        if bound < max(1, best.kth(q)):
            return 0
        self.gain[term] = gain
        touched = []
        while (reach < end).any() and bound >= max(1, best.kth(q)):
            low = np.minimum(begin + depth, end)
            size = np.minimum(end - low, step)
            at = ranges(low, size)
            read += len(at)
            new = np.unique(self.listed[at])
            new = new[~self.met[new]]
            self.met[new] = True
            touched.append(new)
            # Direct access: the entries of each new document, in whatever lists of the query they are.
            length = self.own[new + 1] - self.own[new]
            mine = ranges(self.own[new], length)
            if len(mine):
                score = np.add.reduceat(self.gain[self.term[mine]] * self.impact[mine], np.cumsum(length) - length)
                best.add(q, score, unnamed[new], doc_id[new])
                self.seen[self.place[mine]] = True
            for i, (x, y) in enumerate(zip(reach.tolist(), end.tolist(), strict=True)):
                if x < y:
                    gap = int(self.seen[x:y].argmin())
                    reach[i] = y if self.seen[x + gap] else x + gap
            # Of a list that is seen to its end no document is left.
            bound = int((gain * np.where(reach < end, self.listed_impact[np.maximum(reach - 1, begin)], 0)).sum())
            depth, step = depth + step, 2 * step
        for new in touched:
            self.met[new] = False
            self.seen[self.place[ranges(self.own[new], self.own[new + 1] - self.own[new])]] = False
        self.gain[term] = 0
        return read


def impacts(count: np.ndarray, length: np.ndarray, corpus: Corpus) -> np.ndarray:
    """Of a term's count in a document of so many terms; below 1,000,000."""
    m = 100 - 25 + (25 * length * corpus.documents) // max(1, corpus.length)
    return (1_000_000_000 * count) // (1000 * count + 12 * m)


def search(docs: DataFrame, held: Broadcast, k: int, most: int) -> DataFrame:
    """number, doc_id and score of the k best documents of each query in each task; docs has doc_id and text. held is a block of queries and its Corpus."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, about = held.value
        best = Best(len(queries.numbers), k)
        parts: list[tuple] = []
        n_docs = n_entries = 0

        def finish() -> None:
            doc, term, impact, unnamed, doc_id = (np.concatenate(x) for x in zip(*parts, strict=True))
            lists = Lists(doc, term, impact, len(doc_id), len(queries.terms))
            for q in range(len(queries.numbers)):
                own = slice(queries.at[q], queries.at[q + 1])
                lists.search(queries.term[own], about.weight[queries.term[own]] * queries.times[own], q, best, unnamed, doc_id)

        for b in pieces(batches, "text"):
            doc, term, count, n = entries(b.column("text"), queries.terms)
            name = b.column("doc_id")
            parts.append((doc + n_docs, term, impacts(count, n[doc], about), name.is_null().to_numpy(zero_copy_only=False), name.fill_null(0).to_numpy()))
            n_docs, n_entries = n_docs + len(n), n_entries + len(doc)
            if n_entries >= most or n_docs >= DOCUMENTS:
                finish()
                parts, n_docs, n_entries = [], 0, 0
        if parts:
            finish()
        for i in range(0, len(best.rows), 256):
            rows = best.rows[i : i + 256]
            score, unnamed, doc = (np.concatenate([r[j] for r in rows]) for j in range(3))
            number = np.repeat(queries.numbers[i : i + 256], [len(r[0]) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(doc, mask=unnamed.astype(bool)), pa.array(score)], ["number", "doc_id", "score"])

    return docs.mapInArrow(read, "number long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP, block_bytes: int = BLOCK_BYTES, entries_most: int = ENTRIES) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents of highest score above 0 for each item, ties by ascending doc_id."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = written(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text")), "queries")
    found = docs.sparkSession.createDataFrame([], "number long, doc_id long, score long, rank int")
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block in blocks(asked, block_bytes):
        held = docs.sparkSession.sparkContext.broadcast((block, statistics(rows, block)))
        best = search(rows, held, k, entries_most)
        found = found.unionByName(written(best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "ranked"))
        held.destroy()
    return found.join(asked.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
