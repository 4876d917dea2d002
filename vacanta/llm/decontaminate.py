"""Benchmark decontamination by Wu-Manber search over words.

The windows of the benchmark items are the patterns, words are the symbols and two words are a block. A shift
table over hashed blocks says how far a search may skip; where it says none, the bucket of the window's last
block selects patterns, and their words are compared one by one. Documents are cut into segments whose cursors
move together in numpy. The patterns are taken in blocks of bounded size, each a search over all documents; one
block is the usual case and needs no shuffle; the hits of more blocks are merged by a number given to each row, so that
the result does not depend on the size of a block.

Null texts have no words; items without words have no windows; an item of fewer words than a window is one window.
Items of one id, of any type, count as one; those without id do too, and have no name in the list of ids that digest()
hashes. Repeated rows and rows without id each give a row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.llm.shared import beside, written
from vacanta.llm.text import LETTERS, STEP, Words, mix, words

WINDOW = 10
#: Bytes of benchmark text in one block of patterns. The tables take about 40 times as much memory.
BLOCK_BYTES = 2 << 20
#: Window ends that one cursor walks over.
SEGMENT = 512


class Matcher:
    """Patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set[str | None]]):
        self.m, self.b = length, min(2, length)
        self.words = list(patterns)
        self.items = list(patterns.values())
        flat = words(pa.array([b" ".join(p).decode() for p in self.words]), LETTERS, False)
        self.hash = flat.hash.reshape(len(self.words), length)
        self.bits = max(12, int(8 * self.hash.size).bit_length())
        self.shift = np.full(1 << self.bits, self.m - self.b + 1, np.int32)
        for j in range(self.b - 1, self.m):
            np.minimum.at(self.shift, self.slot(self.hash, j), self.m - 1 - j)
        last = self.slot(self.hash, self.m - 1)
        self.order = np.argsort(last, kind="stable")
        self.slots = last[self.order]

    def slot(self, h: np.ndarray, j) -> np.ndarray:
        """Of the block that ends at j: h is (patterns, words), or j counts in one long row of words."""
        value = h[..., j] * STEP[0]
        if self.b == 2:
            value = value + h[..., j - 1] * STEP[1]
        return (mix(value) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where occurrences begin, counted in words, and the pattern of each."""
        n = np.diff(w.of)
        cuts = np.maximum(0, -(-(n - self.m + 1) // SEGMENT))
        number = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        at = np.repeat(w.of[:-1], cuts) + self.m - 1 + number * SEGMENT
        end = np.minimum(at + SEGMENT, np.repeat(w.of[1:], cuts))
        ends = []
        while len(at):
            skip = self.shift[self.slot(w.hash, at)]
            stop = skip == 0
            ends.append(at[stop])
            at = at + np.maximum(skip, 1)
            go = at < end
            at, end = at[go], end[go]
        ends = np.sort(np.concatenate(ends)) if ends else np.zeros(0, np.int64)
        slot = self.slot(w.hash, ends) if len(ends) else ends
        low, high = np.searchsorted(self.slots, slot, "left"), np.searchsorted(self.slots, slot, "right")
        count = high - low
        where = np.repeat(ends, count) - self.m + 1
        which = self.order[np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
        same = np.ones(len(where), bool)
        for j in range(self.m):
            same[same] = w.hash[where[same] + j] == self.hash[which[same], j]
        where, which = where[same], which[same]
        sure = np.fromiter((all(w.word(i + j) == x for j, x in enumerate(self.words[p])) for i, p in zip(where, which, strict=True)), bool, len(where))
        return where[sure], which[sure]


def matchers(items: list[tuple[str | None, str | None]], window: int) -> list[Matcher]:
    w = words(pa.array([x for _, x in items], pa.string()), LETTERS, True)
    by_length: dict[int, dict[tuple[bytes, ...], set[str | None]]] = defaultdict(lambda: defaultdict(set))
    for (item, _), i, j in zip(items, w.of[:-1], w.of[1:], strict=True):
        size = min(window, j - i)
        if size:
            own = [w.word(k) for k in range(i, j)]
            for k in range(len(own) - size + 1):
                by_length[size][tuple(own[k : k + size])].add(item)
    return [Matcher(size, patterns) for size, patterns in sorted(by_length.items())]


def blocks(items: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """All items, their ids as text, a bounded part at a time; at least one part, if an empty one."""
    part, held, some = [], 0, False
    for item, x in items.select(F.col(item_id).cast("string"), text).toLocalIterator():
        part.append((item, x))
        held += len((x or "").encode())
        if held >= size:
            yield part
            part, held, some = [], 0, True
    if part or not some:
        yield part


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
SPAN_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def found_in(column: pa.Array, patterns: list[Matcher]) -> list[pa.Array]:
    """n_words, hits and items of each text."""
    w = words(column, LETTERS, True)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str | None]] = defaultdict(set)
    for m in patterns:
        where, which = m.search(w)
        doc = np.searchsorted(w.of, where, "right") - 1
        for d, i, p in zip(doc.tolist(), (where - w.of[doc]).tolist(), which.tolist(), strict=True):
            hits[d].append((i, i + m.m - 1))
            items[d].update(m.items[p])
    n = len(column)
    return [
        pa.array(np.diff(w.of).astype(np.int64)),
        pa.array([[{"first": x, "last": y} for x, y in merge(hits[d])] if d in hits else [] for d in range(n)], SPAN_ARROW),
        pa.array([sorted(items[d], key=lambda x: (x is None, x)) if d in items else [] for d in range(n)], pa.list_(pa.string())),
    ]


def search(docs: DataFrame, held: Broadcast, text: str) -> DataFrame:
    """Whole rows as beside() names them, with n_words, hits and items as v0, v1 and v2. held is a block of matchers."""
    return beside(docs, text, lambda x: found_in(x, held.value), [T.LongType(), SPANS, T.ArrayType(T.StringType())])


def marked(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Whole rows as beside() names them, with n_words, hits and items as v0, v1 and v2: the same rows for any block_bytes. Ids of items are text."""
    send = docs.sparkSession.sparkContext.broadcast
    parts = blocks(items, item_id, item_text, block_bytes)
    first = next(parts)
    other = next(parts, None)
    if other is None:
        return search(docs, send(matchers(first, window)), text)
    # Several blocks: rows are numbered once, in a written table. The searches after the first give only rows with hits.
    numbered = written(docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("row", F.monotonically_increasing_id()), "numbered")
    at = f"c{docs.columns.index(text)}"
    held = send(matchers(first, window))
    every, total, part = written(search(numbered, held, at), "hits"), None, other
    held.destroy()
    row = f"c{len(docs.columns)}"
    while part is not None:
        # One block is on the driver at a time; its hits are written before the next is built.
        held = send(matchers(part, window))
        more = search(numbered.select(at, "row"), held, at).filter(F.size("v1") > 0).select(F.col("c1").alias("row"), "v1", "v2")
        more = written(more, "hits")
        held.destroy()
        total = more if total is None else total.unionByName(more)
        part = next(parts, None)
    # Rows with hits in later blocks are a small part of all, and each has at most one row for a block.
    by_row = total.groupBy("row").agg(F.flatten(F.collect_list("v1")).alias("more_hits"), F.flatten(F.collect_list("v2")).alias("more_items"))
    one = every.join(by_row, every[row] == by_row["row"], "left")
    first_of = F.transform(F.array_sort(F.concat("v1", "more_hits")), lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last")))
    none = F.array().cast(SPANS)
    spans = F.when(F.col("more_hits").isNull(), F.col("v1")).otherwise(
        F.aggregate(first_of, none, lambda done, x: F.when((F.size(done) > 0) & (x["first"] <= F.element_at(done, -1)["last"] + 1), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["first"].alias("first"), F.greatest(F.element_at(done, -1)["last"], x["last"]).alias("last"))))).otherwise(F.concat(done, F.array(x))))
    )
    items_ = F.when(F.col("more_items").isNull(), F.col("v2")).otherwise(F.array_sort(F.array_union("v2", "more_items")))
    return one.select(*(f"c{i}" for i in range(len(docs.columns))), "v0", spans.alias("v1"), items_.alias("v2"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: n_words, hits (ranges of words inside an occurrence, apart and ascending), items (their ids, ascending as text)."""
    found = marked(docs.select(doc_id, text), items, text, item_id, item_text, window, block_bytes)
    return found.select(F.col("c0").alias(doc_id), F.col("v0").alias("n_words"), F.col("v1").alias("hits"), F.col("v2").cast(T.ArrayType(items.schema[item_id].dataType)).alias("items"))


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(doc_id, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
