import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.llm import edge

from vacanta.llm import graph, ngram_join, text


def brute(rows):
    sets = []
    for _, x in rows:
        w = edge.SPACE.findall(edge.lower(x or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for d in range(1000, 1060):
        words = rnd.choices(vocabulary, k=rnd.randint(1, 80))
        if d % 3 == 0:
            words = passage + words
        rows.append((d, " ".join(words)))
        near = list(words)
        for i in range(rnd.randint(0, 4)):
            near[rnd.randrange(len(near))] = "new"
            rows.append((d + 1000 * (i + 1), "  ".join(near)))
    chain = [f"c{i}" for i in range(60)]
    rows += [(9000 - i, " ".join(chain[i * 3 :] + [f"t{i}{j}" for j in range(i)])) for i in range(8)]
    return rows


def test_against_brute_force(spark):
    docs = edge.documents(spark, corpus()).filter("doc_id <> 7").repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows)
    assert Counter(map(tuple, ngram_join.link(docs).collect())) == want
    assert Counter(map(tuple, ngram_join.link(docs, frequent_most=1).collect())) == want
    assert any(d != c for d, _, c in want)


def test_empty_and_long(spark):
    assert ngram_join.link(edge.empty(spark)).count() == 0
    got = {tuple(r) for r in ngram_join.link(edge.documents(spark).filter("doc_id in (2, 7)")).collect()}
    assert got == {(2, 0, 2), (7, 2, 7)}


def test_merged_lists_stream(spark):
    rows = [(s, n, k, 3) for s, n, k in ((1, 1, 5), (1, 1, 5), (1, 2, 6), (2, 1, 5), (2, 1, 5), (3, 3, 7), (3, 4, 8), (3, 4, 9))]
    lists = spark.createDataFrame(rows, "shingle long, n long, k1 long, place long")
    want = Counter({(1, 1, 5, 3, 1, 5, 5): 1, (1, 2, 6, 3, 1, 5, 5): 1, (3, 3, 7, 3, 3, 7, 7): 1, (3, 4, 8, 3, 3, 7, 7): 1, (3, 4, 9, 3, 3, 7, 8): 1})
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "2", "3", "100"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert Counter(map(tuple, ngram_join.merged(lists).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_divide_skip():
    rnd = np.random.default_rng(2)
    for size, others in ((1, 1), (5, 3), (60, 1), (200, 40), (400, 7)):
        asking = np.unique(rnd.integers(0, 10 * size, size, dtype=np.uint64))
        sets = []
        for i in range(others):
            kept = asking[rnd.random(len(asking)) < (0.7 + 0.3 * i / others)]
            sets.append(np.unique(np.concatenate([kept, rnd.integers(10 * size, 20 * size, max(1, size // 8), dtype=np.uint64)])))
        for share in (0.5, 0.8, 0.95, 1.0):
            need = [max(1, int(share * len(asking)) - i % 3) for i in range(others)]
            want = [i for i, x in enumerate(sets) if len(np.intersect1d(asking, x)) >= need[i]]
            assert ngram_join.divide_skip(asking, sets, need) == want


def test_blocks_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "HELD", 50)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, " ".join([*base, *(f"x{i}.{j}" for j in range(i % 6))])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for named in (1 << 20, 0):
        monkeypatch.setattr(ngram_join, "NAMED", named)
        assert Counter(map(tuple, ngram_join.link(docs).collect())) == brute(rows)


def test_texts_of_one_id_are_told_apart(spark):
    one, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, one), (1, other), (2, other + " end"), (3, one + " end"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hash", F.lit(1))
    got = ngram_join.link(docs)
    assert Counter(tuple(r)[:3] for r in got.collect()) == brute(rows)
    nameless = ngram_join.link(docs.withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id"))))
    assert nameless.filter("doc_id IS NULL").count() == 3 and nameless.filter("doc_id = 3").count() == 2


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    root = {}
    for a, b in edges:
        if a != b:
            ra, rb = root.setdefault(a, {a}), root.setdefault(b, {b})
            if ra is not rb:
                ra |= rb
                for x in rb:
                    root[x] = ra
    assert got == {x: min(s) for x, s in root.items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_parities_never_differ_more_than_sets():
    rnd = np.random.default_rng(3)
    for size in (1, 9, 90, 900, 9000):
        base = rnd.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        for changed in (0, 1, size // 10, size // 2):
            other = base.copy()
            other[:changed] = rnd.integers(0, 1 << 63, changed, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            both = ngram_join.sketch(np.concatenate([base, other]), np.array([0, size, 2 * size]))
            bits = sum(int(x).bit_count() for x in (both[0] ^ both[1]).view(np.uint64))
            assert bits <= 2 * changed
