"""The registered queries on the smallest tables: columns, and rows against a plain reading of the contract."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tests.llm import edge, test_ngram_join, test_substring_dedup, test_vector_dedup

from vacanta.llm import bpe, queries, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=lambda r: r[0])


def rows(spark, name, *columns):
    got = queries.queries()[name](spark, SF)
    assert got.columns[: len(columns)] == list(columns)
    return Counter(map(tuple, got.select(*columns).collect()))


def test_op1(spark, docs):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, Counter()
    for d, x in docs:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert rows(spark, "op1_token_output", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_op2(spark):
    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows(spark, "op2_vector_dedup", "vec_id", "n_links", "component_id", "kept") == test_vector_dedup.brute(vectors)


def test_op3(spark, docs):
    assert rows(spark, "op3_ngram_join", "doc_id", "n_shingles", "component_id") == test_ngram_join.brute(docs)


@pytest.mark.parametrize(("name", "buckets", "held", "cut"), [("op4_quality", 4, 2, quality.CUT_SCORE), ("op5_toxicity", 5, 0, 0.5)])
def test_scores(spark, docs, name, buckets, held, cut):
    got = rows(spark, name, "doc_id", "held_out", "score", "predicted")
    assert Counter(r[0] for r in got.elements()) == Counter(d for d, _ in docs)
    for d, out, score, predicted in got:
        assert out == (zlib.crc32(str(d).encode()) % buckets == held) and 0 <= score <= 1 and predicted == int(score >= cut)


def test_op6(spark, docs):
    want = Counter({(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()): k for (d, n, gone, kept), k in test_substring_dedup.brute(docs).items()})
    assert rows(spark, "op6_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op8(spark, docs):
    enc, want = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), Counter()
    for d, x in docs:
        ids = enc.encode_ordinary(x or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest()] += 1
    assert rows(spark, "op8_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_repeated_and_null_pages(spark, tmp_path):
    boiler = lambda i: f"<p>menu</p><p>own {i}</p><p></p><div> foot </div>"
    pages = [(i, f"http://a.org/{i}", boiler(i)) for i in range(6)] + [(9, "http://a.org/9", "<p>once</p>")] * 3 + [(20, "http://a.org/n", None), (21, None, boiler(1)), (21, None, boiler(1)), (22, "http://b.org/", "<p>x</p>"), (23, "http://a.org/e", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.oracle_sql()["op10_line_dedup"])
    got = Counter(map(tuple, queries.queries()["op10_line_dedup"](spark, str(tmp_path)).select(*want.columns).collect()))
    assert got == Counter(want.fetchall()) and sum(got.values()) == len(pages)
    # menu and foot stand on 6 of 11 pages; once is one page in three rows, 3 of 11 and so below the ratio.
    assert {r[want.columns.index("text")] for r in got if r[want.columns.index("page_id")] == 9} == {"once"}


def test_edge_rows_are_scored(spark):
    long = edge.documents(spark).filter("doc_id in (7, 10)")
    scores = [tuple(r) for r in quality.score(long, None).collect()]
    assert sorted(scores) == [(7, 1.0), (10, 1.0), (10, 1.0)]
