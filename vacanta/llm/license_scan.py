"""License scan by diagonal voting.

Every run of K words of every document is hashed and joined with the places of the same runs in the license templates; the
words themselves are compared in the join, so a vote is never a mere hash. A vote is for a diagonal: place in the document
minus place in the template. Votes are gathered by document, template and diagonal. A phrase stands wherever one diagonal
has all its runs. Notices may be edited: diagonals at most GAP apart are merged, and the span that they cover is verified
by the share of the template's words that it holds and by its length.

Null and empty texts, and texts of fewer than K words, have no votes; their documents come out without spans. Repeated
rows and rows without id each give a row. Templates of fewer than K words are an error; repeated templates each count.
Extra columns are ignored. The table of runs of templates is broadcast only if Spark finds its written files small enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacanta.llm.shared import ship, written
from vacanta.llm.text import LETTERS, pieces, ranges, spaced, words, runs

K = 3
#: Diagonals that are merged: so many words may be put in or left out at a place.
GAP = 3
#: Share of a notice's words that a span must hold to count for its label.
ENOUGH = 0.8
#: A span of merged diagonals is at most so many times as long as its template.
STRETCH = 1.5

# Phrases, of which each exact place counts, and notices, which may be edited.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "all rights reserved no part of this publication may be reproduced": "all-rights-reserved",
}


def templates(spark: SparkSession) -> DataFrame:
    """text, label and phrase (true: exact places count; false: a notice) of the known templates."""
    return spark.createDataFrame([(t, label, True) for t, label in PHRASES.items()] + [(t, label, False) for t, label in NOTICES.items()], "text string, label string, phrase boolean")


def voted(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Two kinds of rows for each row of a number of its own (row): one with place -1, n_words and the kept columns, and
    one for each run of K words with its place, hash and words."""
    kept = [f"c{i}" for i in range(len(keep))]
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), *(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)))
    names = ["row", "place", "hash", "run", "n_words", *kept]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 18):
            w = words(b.column("text"), LETTERS, True)
            n = np.diff(w.of)
            none = lambda kind, size: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.full(len(n), -1)), none(pa.int64(), len(n)), none(pa.string(), len(n)), pa.array(n), *(b.column(k) for k in kept)], names)
            at = np.flatnonzero(np.arange(len(w.hash)) + K <= w.ends())
            if not len(at):
                continue
            doc = np.repeat(np.arange(len(n)), n)[at]
            data, first, last = spaced(w.data, w.first, w.last)
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                length = last[part + K - 1] - first[part]
                run = pa.StringArray.from_buffers(len(part), pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.py_buffer(data[ranges(first[part], length)]))
                own = doc[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([b.column("row").take(pa.array(own)), pa.array(part - w.of[own]), pa.array(runs(w.hash, K).view(np.int64)[part]), run, none(pa.int64(), len(part)), *(none(b.column(k).type, len(part)) for k in kept)], names)

    kinds = ["row long", "place long", "hash long", "run string", "n_words long", *(f"{k} {numbered.schema[k].dataType.simpleString()}" for k in kept)]
    ship(rows.sparkSession)
    return numbered.mapInArrow(read, ", ".join(kinds))


def template_runs(known: DataFrame) -> DataFrame:
    """The runs of the templates: template (a number), label, phrase, size in words, at, hash and run."""
    every = voted(known, "text", ["label", "phrase"])
    named = every.filter("place < 0").select(F.col("row").alias("template"), F.col("c0").alias("label"), F.col("c1").alias("phrase"), F.col("n_words").alias("size"))
    if not named.filter(F.col("size") < K).isEmpty():
        raise ValueError(f"a template has fewer than {K} words")
    run = every.filter("place >= 0").select(F.col("row").alias("template"), F.col("place").alias("at"), F.col("hash").alias("t_hash"), F.col("run").alias("t_run"))
    return written(named.join(run, "template"), "templates")


def held(at: Column) -> Column:
    """How many words of a template the runs that begin at these places hold."""
    return F.size(F.array_distinct(F.flatten(F.transform(at, lambda x: F.sequence(x, x + K - 1)))))


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, spans. A span has label, phrase, exact, first and last (word places) and part.

    Exact spans are the places of phrases. Others are what one document holds of a template in merged diagonals: part is the
    largest share of its words on one diagonal, or on all merged ones if their span is no longer than STRETCH allows.
    """
    run = template_runs(known)
    # All documents come through this join, with or without votes; those without keep their row of place -1.
    vote = voted(docs, text, [doc_id]).join(run, (F.col("hash") == F.col("t_hash")) & (F.col("run") == F.col("t_run")), "left")
    vote = vote.filter("place = -1 OR template IS NOT NULL").select("row", "place", "n_words", F.col("c0").alias(doc_id), "template", "label", "phrase", "size", "at")
    # One shuffle: what follows groups by row and more.
    diagonal = vote.repartition("row").groupBy("row", "template", (F.col("place") - F.col("at")).alias("d")).agg(
        F.max("n_words").alias("n_words"), F.max(doc_id).alias(doc_id), F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("size").alias("size"), F.collect_set("at").alias("at")
    )
    order = Window.partitionBy("row", "template").orderBy("d")
    merged = diagonal.withColumn("new", F.when(F.col("d") - F.lag("d").over(order) <= GAP, 0).otherwise(1)).withColumn("cluster", F.sum("new").over(order))
    one = F.struct("label", "phrase", F.lit(True).alias("exact"), F.col("d").alias("first"), (F.col("d") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("part"))
    exact = F.when(F.col("phrase") & (F.size("at") == F.col("size") - K + 1), one)
    cluster = merged.groupBy("row", "template", "cluster").agg(
        F.max("n_words").alias("n_words"), F.max(doc_id).alias(doc_id), F.first("label").alias("label"), F.first("phrase").alias("phrase"), F.first("size").alias("size"),
        F.min(F.col("d") + F.array_min("at")).alias("first"), (F.max(F.col("d") + F.array_max("at")) + K - 1).alias("last"),
        F.max(held(F.col("at"))).alias("alone"), F.flatten(F.collect_list("at")).alias("all_at"), F.collect_list(exact).alias("places"),
    )
    short = F.col("last") - F.col("first") + 1 <= STRETCH * F.col("size")
    part = F.greatest("alone", F.when(short, held(F.col("all_at")))) / F.col("size")
    span = F.struct("label", "phrase", F.lit(False).alias("exact"), "first", "last", part.alias("part"))
    some = cluster.withColumn("spans", F.when(F.col("template").isNotNull(), F.concat("places", F.array(span))).otherwise(F.col("places")))
    return some.groupBy("row").agg(F.max(doc_id).alias(doc_id), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).drop("row")


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """n_base, first_word, last_word, base_labels, labels and score of each document's spans."""
    base = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(base, lambda s: s["first"])
    enough = F.filter("spans", lambda s: s["exact"] | (~s["phrase"] & (s["part"] >= ENOUGH)))
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("spans", lambda s: s["part"])), F.lit(0.0))
    return found.select(doc_id, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(enough).alias("labels"), score.alias("score"))
