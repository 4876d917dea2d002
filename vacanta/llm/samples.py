"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def known(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y of all labelled rows; a doc_id counts once, with its largest label."""
    return labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int]) -> DataFrame:
    """Texts with label y of at most most[0] and most[1] rows of label 0 and 1, chosen by a hash of doc_id: doc_id, text, y.

    A doc_id counts once, with its largest label; rows whose label is not 0 or 1 are left out.
    """
    every = known(labels, label)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [every.filter(F.col("y") == y).orderBy(*order).limit(most[y]) for y in (0, 1)]
    # At most most[0] + most[1] rows of two numbers are broadcast.
    chosen = F.broadcast(parts[0].union(parts[1]))
    return docs.select("doc_id", "text").join(chosen, "doc_id")
