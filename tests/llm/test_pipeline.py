import hashlib

import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers as P
from tests.llm import edge, test_ngram_join
from tests.llm.test_classifiers import corpus

from vacanta.llm import bpe


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, truth = corpus(spark)
    rows = [(r["doc_id"], r["text"] + "\nshared foot line", "en", "site", 1) for r in docs.collect()]
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    near = rows[3][1].replace("\n", " again\n")
    rows += [(5000, near, "en", "site", 1), (5001, rows[7][1] + " " + passage, "en", "other", 1), (5002, None, "en", "other", 1), (5003, rows[10][1], "en", "site", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage.upper())], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = frame
    for name, stage in pipeline.STAGES[:-1]:
        was, kept = kept, stage(spark, kept, str(tmp_path))
        assert kept.columns == frame.columns
        before = {r["doc_id"]: r["text"] for r in was.collect()}
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert set(after) <= set(before)
        if name == "quality":
            assert np.mean([(d in after) == truth[d][0] for d in truth]) > 0.97
        elif name == "lines":
            assert set(after) == set(before)
            for d, x in before.items():
                want = x.replace("\nshared foot line", "") if x and d < 5001 or d == 5003 else x
                assert after[d] == want, d
        elif name == "near_duplicates":
            assert set(after) == {d for d, _, c in test_ngram_join.brute(sorted(before.items())) if d == c}
        else:
            assert set(before) - set(after) == {5001} & set(before)
    got = {r["doc_id"]: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(after)
    enc = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for d, x in after.items():
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(enc.encode_ordinary(x or ""), "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()


def test_empty(spark):
    from vacanta.llm import decontaminate, line_dedup, ngram_join, quality

    docs = edge.empty(spark)
    assert quality.score(docs, None).count() == line_dedup.drop_boilerplate(docs.drop("n_words", "label"), "source").count() == ngram_join.link(docs).count() == 0
    assert decontaminate.decontaminate(docs, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_stages_keep_rows_without_id_and_repeated_ones(spark, tmp_path):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    docs = edge.documents(spark)
    nameless = spark.createDataFrame([(None, base, "en", None, 7, 8)] * 2 + [(1, "another text of the same number", "en", None, 7, 8)], docs.schema)
    docs = docs.union(nameless).selectExpr("*", "1 AS c0", "2 AS v0", "3 AS drop", "4 AS k1", "5 AS text_hash", "6 AS hits", "7 AS `a b.c`", "0L AS n_chars")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "short, ONE!"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = lambda df: sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in df.collect())
    want = ids(docs)
    # 5 is a copy of 1, and 6 has 12 of its 13 shingles; 8 is an item of the benchmark.
    gone = {"quality": [], "lines": [], "near_duplicates": [5, 6], "benchmark": [8]}
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns[-2:] == ["a b.c", "n_chars"]
        want = [x for x in want if not (x[0] and x[1] in gone[name])]
        assert ids(docs) == want, name
        assert {r["c0"] for r in docs.collect()} == {1}
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(want)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
