"""Token ids in ORC files, in document order.

A file holds one range of doc_id, ascending: doc_id, part (number of the range), pos (tokens of the range before
the document), n_tokens and ids. ORC keeps ids as run-length coded integers in stripes that readers take one by
one; row indexes and Bloom filters on doc_id let a lookup skip stripes and row groups. The texts are shuffled
once, by range, before they are encoded; offsets over all files come from one sum for each file.

Texts may be null or empty (only the end id), of any length, and repeated: each row gives a row, and rows with one
doc_id are ordered by their text. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacanta.llm.shared import partitions, ship
from vacanta.llm.text import pieces

#: Words, and units (runs of letters or signs), that a worker remembers the ids of; beyond these they are encoded anew.
KNOWN_WORDS = 900_000
KNOWN_UNITS = 500_000
_known: dict = {}

#: Words of letters up to U+00FF, digits and ASCII signs.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9!\"#$%&'()*+,./:;<=>?@\[\\\]^_`{|}~-]*")
#: The units that the tokenizer cuts such a word to, once it is lower case: a fixed value.
UNIT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-zß-öø-ÿ0-9]+")
#: How a tokenizer's file must say that it normalises and cuts texts for these rules to hold.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


class Encoder:
    """Ids of texts by one tokenizer.

    If it drops white space, lower-cases and cuts a text to units by the rules above, plain words are cut here, and each
    distinct unit is merged once by the tokenizer's own model; other words go through the whole tokenizer. A tokenizer
    with other rules is given whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.units: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        rules = json.loads(self.tokenizer.to_str())
        cut = (rules["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.by_word = rules["normalizer"] == NORMALIZER and cut[0] == SPLIT and [x["type"] for x in cut[1:]] == ["ByteLevel"] and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        if not self.by_word:
            return
        # How the tokenizer spells the bytes of letters beyond ASCII.
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.spelling = {ord(c): spell(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}

    def merged(self, u: str) -> bytes:
        ids = self.units.get(u)
        if ids is None:
            ids = array("i", [t.id for t in self.model.tokenize(u if u.isascii() else u.translate(self.spelling))]).tobytes()
            if len(self.units) < KNOWN_UNITS:
                self.units[u] = ids
        return ids

    def whole(self, word: str) -> bytes:
        return array("i", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.merged, UNIT.findall(word.lower())))
        return self.whole(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit integers of each text."""
        if not self.by_word:
            return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        known, beyond, out = self.words, {}, []
        for x in texts:
            doc = x.replace("\n", " ").split(" ")
            # Each word is looked up once; a text without a new word, most of them, is joined at once.
            ids = list(map(known.get, doc))
            try:
                out.append(b"".join(ids))
            except TypeError:
                for i, (w, found) in enumerate(zip(doc, ids, strict=True)):
                    if found is None:
                        found = known.get(w) or beyond.get(w)
                        if found is None:
                            found = self.word(w)
                            (known if len(known) < KNOWN_WORDS else beyond)[w] = found
                        ids[i] = found
                out.append(b"".join(ids))
        return out


def encode_texts(path: str, texts: list[str | None], end_id: int) -> list[bytes]:
    if path not in _known:
        _known[path] = Encoder(path)
    end = array("i", [end_id]).tobytes()
    return [x + end for x in _known[path].encode([x or "" for x in texts])]


def encode(docs: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document, in ranges of doc_id."""

    def run(batches):
        part, pos = TaskContext.get().partitionId(), 0
        for b in pieces(batches, text):
            ids = encode_texts(tokenizer, b.column(text).to_pylist(), end_id)
            n = np.array([len(x) // 4 for x in ids], np.int64)
            before = pos + np.cumsum(n) - n
            pos += int(n.sum())
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(doc_id), pa.array(np.full(len(n), part, np.int32)), pa.array(before), pa.array(n), lists], ["doc_id", "part", "pos", "n_tokens", "ids"])

    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    ranged = docs.select(doc_id, text).repartitionByRange(partitions(docs.sparkSession), doc_id).sortWithinPartitions(doc_id, text)
    return ranged.mapInArrow(run, f"doc_id {kind}, part int, pos long, n_tokens long, ids array<int>")


def write(encoded: DataFrame, path: str, stripe_bytes: int = 16 << 20, stride: int = 1000) -> None:
    (
        encoded.write.option("orc.stripe.size", str(stripe_bytes))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("compression", "zstd")
        .orc(path)
    )


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written; a filter on doc_id goes down to the stripes and row groups that may hold it."""
    return spark.read.orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of a written folder."""
    files = read_rows(spark, path)
    total = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row for each file meets in this window, however long the files are.
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = total.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    # As many rows as there are files, whatever the size of the files.
    return files.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("pos")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = b.column("ids")
            at = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    ship(tokens.sparkSession)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
