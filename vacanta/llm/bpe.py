"""Byte-level BPE with the tiktoken library and a local rank file.

encode: (doc_id, text) to (doc_id, ids); ids are packed little-endian unsigned 32-bit integers, so that a row is
one byte string and JVM functions can count and digest it. decode: the raw bytes of such ids, which need not be
UTF-8. A null or empty text has no ids. Repeated rows and ids each give a row; no row depends on another, so a
lost task is just run again.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacanta.llm.shared import ship
from vacanta.llm.text import pieces

#: A match of the pattern never holds white space after another character, so a text may be cut between
#: a letter or digit and the white space that follows.
CUT = re.compile(r"[^\W_](?=[ \n\t])")
LONG = 1 << 16
_known: dict = {}


def encoder(path: str, pattern: str):
    """One encoder for each worker process."""
    if (path, pattern) not in _known:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _known[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _known[path, pattern]


def safe_parts(text: str, size: int = LONG) -> list[str]:
    """The text in parts of about size characters that can be encoded one by one."""
    out, begin = [], 0
    while len(text) - begin > size:
        cut = CUT.search(text, begin + size)
        if cut is None:
            break
        out.append(text[begin : cut.end()])
        begin = cut.end()
    return [*out, text[begin:]]


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches):
        enc = encoder(ranks, pattern)
        for b in pieces(batches, text):
            out = []
            for x in b.column(text).to_pylist():
                ids: list[int] = []
                for part in safe_parts(x) if x else ():
                    ids += enc.encode_ordinary(part)
                out.append(np.array(ids, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(doc_id), pa.array(out, pa.binary())], [doc_id, "ids"])

    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, ids binary")


def decode(tokens: DataFrame, ranks: str, pattern: str, ids: str = "ids") -> DataFrame:
    """tokens with a column decoded, binary, in place of any of that name; null ids decode to no bytes."""
    tokens = tokens.drop("decoded")
    schema = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        enc = encoder(ranks, pattern)
        for b in batches:
            out = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], schema.names)

    ship(tokens.sparkSession)
    return tokens.mapInArrow(run, schema)


def digest(coded: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return coded.select(
        doc_id,
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
