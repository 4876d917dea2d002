from collections import Counter

import pytest
from tests.llm import edge

from vacanta.llm import license_scan

NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]


def words(text):
    return edge.LETTERS.findall(edge.lower(text or ""))


def base(doc_id, text):
    w = words(text)
    at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return (doc_id, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))


def test_base_places(spark):
    extra = [
        (20, "Released under the MIT License."), (21, "CC BY-NC 4.0 " * 3000), (22, "cc by nc cc by nc under the mit license under the mit license"), (23, "the Apache License, Version 2.0; under the mit  LICENSE"),
        (24, "cc by"), (25, "under the mit licenses"), (None, "cc by nc"), (None, "cc by nc"), (26, "cc bync cc by-NC"), (27, "under the ünder the mit license"), (27, "cc"),
    ]
    docs = edge.documents(spark, extra).repartition(3)
    got = license_scan.digest(license_scan.scan(docs, license_scan.templates(spark)))
    assert Counter(tuple(r[c] for c in NAMES) for r in got.collect()) == Counter(base(r["doc_id"], r["text"]) for r in docs.collect())
    assert all(0 <= r["score"] <= 1 for r in got.collect())


@pytest.fixture(scope="module")
def labels(spark):
    gpl = next(t for t, x in license_scan.NOTICES.items() if x == "gpl-3").split()
    bsd = next(t for t, x in license_scan.NOTICES.items() if x == "bsd").split()
    mid = len(bsd) // 2
    rows = [
        (1, " ".join(gpl)), (2, " ".join(gpl[:4])), (3, "intro " * 50 + " ".join([*bsd[:mid], "and", "also", *bsd[mid:]])), (4, " ".join(bsd[:mid] + ["far"] * 300 + bsd[mid:])),
        (5, " ".join(bsd[: mid - 1] + bsd[mid + 1 :])), (6, " ".join(reversed(bsd))), (7, "under the mit license " + " ".join(gpl)), (8, None), (9, "under the mit office"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r for r in license_scan.digest(license_scan.scan(docs, license_scan.templates(spark))).collect()}


def test_notices(labels):
    assert {i: r["labels"] for i, r in labels.items()} == {1: "gpl-3", 2: "", 3: "bsd", 4: "", 5: "bsd", 6: "", 7: "gpl-3,mit", 8: "", 9: ""}
    assert labels[1]["score"] == labels[7]["score"] == labels[3]["score"] == 1.0
    assert 0 < labels[4]["score"] < 0.8 and labels[6]["score"] == labels[8]["score"] == 0.0 and labels[9]["score"] == 0.75


def test_spans_say_where(spark):
    text = "one two under the mit license three Released under the MIT license"
    docs = spark.createDataFrame([("x", text)], "name string, body string")
    spans = license_scan.scan(docs, license_scan.templates(spark), "name", "body").first()["spans"]
    assert [(s["first"], s["last"]) for s in spans if s["exact"]] == [(2, 5), (8, 11)]
    assert ("mit", 7, 11) in [(s["label"], s["first"], s["last"]) for s in spans if not s["phrase"] and s["part"] == 1.0]


def test_own_templates(spark):
    known = spark.createDataFrame([("a b c d e", "own", True), ("a b c d e", "own", True)], "text string, label string, phrase boolean")
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d")], "doc_id long, text string")
    assert {r["doc_id"]: (r["n_base"], r["score"]) for r in license_scan.digest(license_scan.scan(docs, known)).collect()} == {1: (2, 1.0), 2: (0, 0.8)}
    with pytest.raises(ValueError, match="fewer"):
        license_scan.scan(docs, spark.createDataFrame([("a b", "x", True)], known.schema))


def test_empty(spark):
    assert license_scan.digest(license_scan.scan(edge.empty(spark), license_scan.templates(spark))).count() == 0
