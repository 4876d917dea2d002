"""Words and hashes of many UTF-8 texts at once, as numpy arrays over one byte buffer.

Every function works on one Arrow batch inside a task. Hashes are 64 bits: sums of per-byte values times
per-position weights, mixed; equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 40)) * U64(0x9E3779B97F4A7C15)) | U64(1)


BYTE = stream(256, 1)
WEIGHT = stream(4096, 2)
STEP = stream(64, 3)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
LETTERS = np.ones(256, bool)
LETTERS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 places where each begins; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = text_bytes(batch.column(text))
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
        # Freed buffers go back to the system: a worker shares its memory with a JVM and other workers.
        pa.default_memory_pool().release_unused()


@dataclass
class Words:
    data: np.ndarray  # bytes, lowered if asked for
    first: np.ndarray  # where each word begins
    last: np.ndarray  # and ends
    of: np.ndarray  # n + 1: the words of document i are of[i] to of[i + 1]
    hash: np.ndarray

    def word(self, i: int) -> bytes:
        return self.data[self.first[i] : self.last[i]].tobytes()

    def ends(self) -> np.ndarray:
        """For each word the end of its document, counted in words."""
        return np.repeat(self.of[1:], np.diff(self.of))


def spans(column: pa.Array, kind: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data, first, last and of, as Words has them."""
    data, at = text_bytes(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = kind[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[at] = False
    first = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[at] = False
    last = np.flatnonzero(inside & ~after[1:]) + 1
    return data, first, last, np.searchsorted(first, at)


def words(column: pa.Array, kind: np.ndarray, lower: bool) -> Words:
    data, first, last, of = spans(column, kind, lower)
    if not len(first):
        return Words(data, first, last, of, np.zeros(0, U64))
    length = last - first
    begin = np.cumsum(length) - length
    weight = WEIGHT if length.max() <= len(WEIGHT) else stream(int(length.max()), 2)
    at = ranges(first, length)
    value = BYTE[data[at]]
    value *= weight[at - np.repeat(first, length)]
    found = np.add.reduceat(value, begin) + length.astype(U64)
    return Words(data, first, last, of, mix(found))


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... so many as length[0], and so on for each."""
    return np.arange(int(length.sum())) + np.repeat(first - (np.cumsum(length) - length), length)


def spaced(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words with one space after each: the bytes, and where each word begins and ends."""
    length = last - first
    begin = np.cumsum(length + 1) - (length + 1)
    out = np.full(int((length + 1).sum()), 0x20, np.uint8)
    out[ranges(begin, length)] = data[ranges(first, length)]
    return out, begin, begin + length


def runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of each k words in a row, by where they begin; the last k - 1 places have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, salt, U64)
    for j in range(k):
        out += hashes[j : j + n] * STEP[j]
    return mix(out)


def whole(w: Words, salt: int) -> np.ndarray:
    """One hash of the word sequence of each document."""
    n = np.diff(w.of)
    out = n.astype(U64) + U64(salt)
    if len(w.hash):
        place = np.arange(len(w.hash)) - np.repeat(w.of[:-1], n)
        weight = stream(int(n.max()), 4 + salt)
        full = n > 0
        out[full] += np.add.reduceat(mix(w.hash + U64(salt)) * weight[place], w.of[:-1][full])
    return mix(out)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each document, ascending, and the n + 1 places where its own begin.

    With fewer than k words, but not none, the whole sequence is the one shingle.
    """
    n = np.diff(w.of)
    grams = runs(w.hash, k)
    begin = np.arange(len(grams))
    ok = begin + k <= w.ends()[: len(grams)]
    doc = np.repeat(np.arange(len(n)), n)[: len(grams)][ok]
    value = grams[ok]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        doc = np.concatenate([doc, short])
        value = np.concatenate([value, whole(w, 7)[short]])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
