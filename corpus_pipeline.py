"""Five stages that take documents to token ids. Each stage reads what the one before wrote.

For every stage: an empty table gives an empty table; null and empty texts are texts without words; repeated rows are
judged alike and stay or go together; columns may have any names besides doc_id, text and source. Rows are judged as
rows: two rows of one doc_id with different texts are judged apart, and rows without doc_id are kept like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacanta.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from vacanta.llm.queries import pattern, vocabulary
from vacanta.llm.shared import restored, table, written


#: Names of near copies that are broadcast, some 50 bytes each; of more than these, texts and names are shuffled.
GOING = 1 << 21


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the cut go. The model is trained on the labelled rows of the stage's own input.

    Without labelled rows of both kinds all stay. Null and empty texts are scored like others.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rated = quality.rated(docs, model)
    return restored(rated.filter(F.col("v0") >= quality.CUT_SCORE), docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its documents; n_chars is counted anew. All rows stay; null texts stay null."""
    cleaned = line_dedup.drop_boilerplate(docs, "source")
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least doc_id stays; if its row is repeated, with its copies.

    Documents without words or without doc_id are in no group and stay. Rows are told apart by doc_id and a 64-bit hash
    of the text; only those that go are joined back, so the texts move only if these are more than GOING.
    """
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    going = ngram_join.link(named, carried="text_hash").filter("doc_id <> component_id").select("doc_id", "text_hash").distinct()
    going = written(going.toDF("_going_id", "_going_hash"), "going")
    if going.count() <= GOING:
        going = F.broadcast(going)
    return docs.join(going, (F.col("doc_id") == F.col("_going_id")) & (F.xxhash64("text") == F.col("_going_hash")), "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.marked(docs, table(spark, sf_dir, "benchmark"))
    return restored(found.filter(F.size("v1") == 0), docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to; a row for each row."""
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    return bpe.digest(bpe.decode(bpe.encode(docs, ranks, pattern()), ranks, pattern()))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

#: The trained scores of the first stage and the tokens of the last are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
