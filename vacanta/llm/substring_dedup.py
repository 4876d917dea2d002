"""Substring dedup with a log-structured index of window fingerprints.

A window is 13 words in a row. Its fingerprint is the least hash of the 4-word runs inside it; as the windows that
share one lie side by side, a text has one entry for some five windows: fingerprint, document, place, and for
each window the 64 bits of the hash of its 13 words, which verify a match. Equal windows have equal entries
wherever they stand, so every window is judged. All windows around one frequent 4-word run have the same
fingerprint, so only the hash of the 13 words tells them apart: a false match needs those 64 bits to be equal.

The index is a list of immutable runs, tables of fingerprints and window bits, sorted in each bucket, without
document ids: what is in a run came in an earlier batch. A new batch is dealt to the buckets of the runs and merge-joined with
them; a window is repeated if a run holds it or a smaller doc_id of the batch does. The windows that no run holds
make the next run. compact() merges runs into one.

Entries that are the same in several documents of one part of a task are sent once, for the smallest doc_id, the
others are judged there; so a passage in a third of all documents sends one entry for each part. Buckets and
document groups are sized by the bytes of the batch. Null and empty texts have no words; rows without doc_id keep all
their words and repeat nothing. doc_id is an integer. Rows of one doc_id are told apart by a 64-bit hash of their text:
a window is not repeated by another row of its own document, and what is removed from one of its texts stays in the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacanta.llm.shared import ship, written
from vacanta.llm.text import NOT_SPACE, mix, pieces, runs, words

WINDOW = 13
RUN = 4
#: Batches of dedup(): where the range of ids is cut, and how many runs are compacted to one. Runs are written and shuffled
#: again with every batch, so the history before the last batch is kept small.
EDGES, MOST_RUNS = (1 / 32, 2 / 32, 3 / 32), 3
#: Bytes of text for each bucket of fingerprints and each group of documents.
BUCKET_BYTES = 8 << 20

ENTRIES = "bucket int, fp binary, doc binary, txt binary, pos binary, size binary, bits binary"
RUNS = "bucket int, fp binary, size binary, bits binary"
OUT = "grp int, doc binary, txt binary, pos binary, size binary, bucket int, fp binary, bits binary"


@dataclass
class Index:
    buckets: int
    runs: list[DataFrame] = field(default_factory=list)


def entries(column: pa.Array) -> tuple[np.ndarray, ...]:
    """fp, row, pos and size of each entry, and the bits of all windows, entry after entry."""
    w = words(column, NOT_SPACE, False)
    full = runs(w.hash, WINDOW)
    ok = np.arange(len(full)) + WINDOW <= w.ends()[: len(full)]
    inner = runs(w.hash, RUN, 11)
    best = inner[: len(full)].copy()
    arg = np.arange(len(full))
    for j in range(1, WINDOW - RUN + 1):
        next_ = inner[j : j + len(full)]
        less = next_ < best
        best = np.where(less, next_, best)
        arg[less] = np.flatnonzero(less) + j
    at = np.flatnonzero(ok)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none, none.view(np.uint64)
    doc = np.searchsorted(w.of, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (arg[at][1:] != arg[at][:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    return best[at[first]], doc[first], at[first] - w.of[doc[first]], size, full[at]


def expand(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each, so many."""
    return np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (mix(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def packed(key: np.ndarray, columns: list[np.ndarray], sizes: np.ndarray | None = None, flat: np.ndarray | None = None):
    """For each key, ascending: the key and the bytes of its part of every column, and of what it has of flat."""
    order = np.argsort(key, kind="stable")
    keys, at = np.unique(key[order], return_index=True)
    cut = np.append(at, len(key))
    out = []
    columns = [c[order] for c in columns]
    if flat is not None:
        begin = np.cumsum(sizes) - sizes
        flat = flat[expand(begin[order], sizes[order])]
        edge = np.concatenate([[0], np.cumsum(sizes[order])])
    for k, a, b in zip(keys.tolist(), cut[:-1], cut[1:], strict=True):
        row = [k, *(c[a:b].tobytes() for c in columns)]
        if flat is not None:
            row.append(flat[edge[a] : edge[b]].tobytes())
        out.append(row)
    return out


def batch_of(rows: list[list], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def fingerprints(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """Entries by bucket; those judged at once have a bucket below zero and no bits."""

    def run(batches):
        for b in pieces(batches, text, 2 << 20):
            fp, row, pos, size, bits = entries(b.column(text))
            doc, txt = b.column(doc_id).to_numpy()[row], b.column("txt").to_numpy()[row].astype("<i8")
            if not len(fp):
                continue
            begin = np.cumsum(size) - size
            same = np.add.reduceat(mix(bits + mix(expand(np.zeros(len(size), np.int64), size).astype(np.uint64))), begin) + mix(fp)
            order = np.lexsort((doc, same))
            new = np.ones(len(order), bool)
            new[1:] = same[order][1:] != same[order][:-1]
            least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            kept = np.empty(len(order), bool)
            kept[order] = doc[order] == least
            d64, p32, s8 = doc.astype("<i8"), pos.astype("<u4"), size.astype("u1")
            held = np.flatnonzero(kept)
            out = packed((fp[held] >> np.uint64(33)).astype(np.int64) % buckets, [fp[held], d64[held], txt[held], p32[held], s8[held]], size[held], bits[expand(begin[held], size[held])])
            rest = np.flatnonzero(~kept)
            out += [[-1 - k, b"", *x, b""] for k, *x in packed(group_of(d64[rest], buckets), [d64[rest], txt[rest], p32[rest], s8[rest]])]
            yield batch_of(out, ENTRIES)

    return docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias(doc_id), F.col(text), F.xxhash64(text).alias("txt")).mapInArrow(run, ENTRIES)


def joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def judge(buckets: int, keep_run: bool):
    """The function for one bucket: entries of the batch and all runs in, repeated windows and the next run out."""

    def one(key, new: pa.Table, old: pa.Table | None = None) -> pa.Table:
        out = []
        bucket = new.column("bucket")[0].as_py() if new.num_rows else -1
        doc, txt, pos, size = joined(new, "doc", "<i8"), joined(new, "txt", "<i8"), joined(new, "pos", "<u4"), joined(new, "size", "u1").astype(np.int64)
        if new.num_rows and bucket < 0:
            out = [[g, *x, None, None, None] for g, *x in packed(group_of(doc, buckets), [doc, txt, pos, size.astype("u1")])]
        elif new.num_rows:
            fp, bits = joined(new, "fp", "<u8"), joined(new, "bits", "<u8")
            fps, of, count = np.unique(fp, return_inverse=True, return_counts=True)
            was = np.zeros(0, np.uint64)
            if old is not None and old.num_rows:
                was, was_size, was_bits = joined(old, "fp", "<u8"), joined(old, "size", "<u4").astype(np.int64), joined(old, "bits", "<u8")
            begin = np.cumsum(size) - size
            shared = (count[of] > 1) | np.isin(fp, was)
            some = np.flatnonzero(shared)
            place = expand(begin[some], size[some])
            entry = np.repeat(some, size[some])
            f, x, d = of[entry], bits[place], doc[entry]
            o_f, o_x = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            if len(was):
                hit = np.minimum(np.searchsorted(fps, was), len(fps) - 1)
                ok = np.flatnonzero(fps[hit] == was)
                o_f = np.repeat(hit[ok], was_size[ok])
                o_x = was_bits[expand((np.cumsum(was_size) - was_size)[ok], was_size[ok])]
            # What a run holds sorts first, as a document below all others.
            f, x = np.concatenate([o_f, f]).astype(np.int64), np.concatenate([o_x, x]).astype(np.uint64)
            d = np.concatenate([np.full(len(o_f), np.iinfo(np.int64).min), d])
            order = np.lexsort((d, x, f))
            f, x, d = f[order], x[order], d[order]
            head = np.ones(len(f), bool)
            head[1:] = (f[1:] != f[:-1]) | (x[1:] != x[:-1])
            at = np.maximum.accumulate(np.where(head, np.arange(len(f)), 0)) if len(f) else np.zeros(0, np.int64)
            repeated = np.zeros(len(f), bool)
            repeated[order] = (d > d[at]) & (order >= len(o_f)) if len(f) else False
            repeated = repeated[len(o_f) :]
            start = pos[entry] + (place - begin[entry])
            out = ranges(doc[entry][repeated], txt[entry][repeated], start[repeated], buckets)
            if keep_run:
                alone = np.flatnonzero(~shared)
                whole_place = expand(begin[alone], size[alone])
                fresh = head & (d != np.iinfo(np.int64).min)
                n_f = np.concatenate([np.repeat(of[alone], size[alone]), f[fresh]])
                n_x = np.concatenate([bits[whole_place], x[fresh]])
                out.append([None, None, None, None, *run_row(bucket, fps[n_f], n_x)])
        return pa.Table.from_batches([out_batch(out)])

    return one


def run_row(bucket: int, fp: np.ndarray, bits: np.ndarray) -> list:
    """size, bucket, fp and bits of a run: sorted, each window once."""
    order = np.lexsort((bits, fp))
    fp, bits = fp[order], bits[order]
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (bits[1:] != bits[:-1])
    fp, bits = fp[new], bits[new]
    fps, n = np.unique(fp, return_counts=True)
    return [n.astype("<u4").tobytes(), bucket, fps.astype("<u8").tobytes(), bits.astype("<u8").tobytes()]


def out_batch(rows: list[list]) -> pa.RecordBatch:
    # rows of ranges are grp, doc, txt, pos, size, -, -, -; the row of a run is -, -, -, -, size, bucket, fp, bits
    return batch_of(rows, OUT)


def ranges(doc: np.ndarray, txt: np.ndarray, start: np.ndarray, groups: int) -> list[list]:
    """Windows that begin side by side in one text as a range of up to 255, packed by document group."""
    order = np.lexsort((start, txt, doc))
    doc, txt, start = doc[order], txt[order], start[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (txt[1:] != txt[:-1]) | (start[1:] != start[:-1] + 1)
    run_at = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) if len(doc) else np.zeros(0, np.int64)
    new |= (np.arange(len(doc)) - run_at) % 255 == 0
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(doc)))
    return [[g, *x, None, None, None] for g, *x in packed(group_of(doc[first], groups), [doc[first].astype("<i8"), txt[first].astype("<i8"), start[first].astype("<u4"), size.astype("u1")])]


def add(index: Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_run: bool = True) -> tuple[DataFrame, Index]:
    """The repeated windows of a batch, packed by document group, and the index with the batch's run."""
    ship(docs.sparkSession)
    new = fingerprints(docs, doc_id, text, index.buckets).groupBy("bucket")
    if index.runs:
        old = index.runs[0]
        for r in index.runs[1:]:
            old = old.unionByName(r)
        found = new.cogroup(old.groupBy("bucket")).applyInArrow(three(judge(index.buckets, keep_run)), OUT)
    else:
        found = new.applyInArrow(two(judge(index.buckets, keep_run)), OUT)
    found = written(found, "fingerprints")
    runs_ = [*index.runs, found.filter("bucket IS NOT NULL").select("bucket", "fp", "size", "bits")] if keep_run else index.runs
    return found.filter("grp IS NOT NULL").select("grp", "doc", "txt", "pos", "size"), Index(index.buckets, runs_)


def two(f):
    def g(new: pa.Table) -> pa.Table:
        return f(None, new)

    return g


def three(f):
    def g(new: pa.Table, old: pa.Table) -> pa.Table:
        return f(None, new, old)

    return g


def compact(index: Index) -> Index:
    """All runs as one, each window once. The files of the old runs are no longer read."""

    def one(t: pa.Table) -> pa.Table:
        fp, size, bits = joined(t, "fp", "<u8"), joined(t, "size", "<u4").astype(np.int64), joined(t, "bits", "<u8")
        size_, bucket, fps, kept = run_row(t.column("bucket")[0].as_py(), np.repeat(fp, size), bits)
        return pa.Table.from_batches([batch_of([[bucket, fps, size_, kept]], RUNS)])

    if len(index.runs) < 2:
        return index
    every = index.runs[0]
    for r in index.runs[1:]:
        every = every.unionByName(r)
    ship(every.sparkSession)
    return Index(index.buckets, [written(every.select("bucket", "fp", "size", "bits").groupBy("bucket").applyInArrow(one, RUNS), "run")])


def remove(docs: DataFrame, found: DataFrame, groups: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the other words, joined by one space)."""

    def pack(batches):
        import zstandard

        small = zstandard.ZstdCompressor(level=3)
        for b in pieces(batches, text, 2 << 20):
            ids = b.column(doc_id)
            grp = group_of(ids.fill_null(0).to_numpy().astype("<i8"), groups)
            yield pa.RecordBatch.from_arrays([pa.array(grp), ids, b.column("txt"), pa.array([small.compress((x or "").encode()) for x in b.column(text).to_pylist()], pa.binary())], ["grp", "doc_id", "txt", "packed"])

    def apply(texts: pa.Table, marks: pa.Table) -> pa.Table:
        import zstandard

        large = zstandard.ZstdDecompressor()
        doc, txt, pos, size = joined(marks, "doc", "<i8"), joined(marks, "txt", "<i8"), joined(marks, "pos", "<u4").astype(np.int64), joined(marks, "size", "u1").astype(np.int64)
        order = np.lexsort((txt, doc))
        doc, txt, pos, size = doc[order], txt[order], pos[order], size[order]
        ids = texts.column("doc_id").to_pylist()
        n, removed, kept = [], [], []
        for d, h, x in zip(ids, texts.column("txt").to_pylist(), texts.column("packed").to_pylist(), strict=True):
            w = large.decompress(x).split()
            a, b = (np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")) if d is not None else (0, 0)
            a, b = a + np.searchsorted(txt[a:b], h, "left"), a + np.searchsorted(txt[a:b], h, "right")
            n.append(len(w))
            if a == b:
                removed.append(0)
                kept.append(b" ".join(w).decode())
                continue
            step = np.zeros(len(w) + 1, np.int64)
            np.add.at(step, np.minimum(pos[a:b], len(w)), 1)
            np.add.at(step, np.minimum(pos[a:b] + size[a:b] + WINDOW - 1, len(w)), -1)
            free = np.cumsum(step)[:-1] == 0
            removed.append(int(len(w) - free.sum()))
            kept.append(b" ".join(compress(w, free.tolist())).decode())
        return pa.table([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    ship(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text), F.xxhash64(text).alias("txt")).mapInArrow(pack, "grp int, doc_id long, txt long, packed binary")
    return texts.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edges: tuple[float, ...] = EDGES, most_runs: int = MOST_RUNS) -> DataFrame:
    """The documents as batches in ascending order of doc_id, cut at these shares of the range of ids.

    The first batch makes a run; every further one is merge-joined with the runs that there are and adds its own, and
    most_runs of them are compacted to one before the next batch comes. The last batch needs no run.
    """
    size, low, high = docs.agg(F.sum(F.octet_length(F.col(text))), F.min(doc_id), F.max(doc_id)).first()
    index = Index(max(8, -(-(size or 0) // BUCKET_BYTES)))
    if low is None:
        low = high = 0
    ends = [low + int((high + 1 - low) * e) for e in edges] + [high + 1]
    found = None
    for i, (first, last) in enumerate(zip([low, *ends[:-1]], ends, strict=True)):
        final = i + 1 == len(ends)
        part, index = add(index, docs.filter((F.col(doc_id) >= first) & (F.col(doc_id) < last)), doc_id, text, keep_run=not final)
        found = part if found is None else found.unionByName(part)
        if len(index.runs) >= most_runs and not final:
            index = compact(index)
    return remove(docs, found, index.buckets, doc_id, text)
