import random
from collections import Counter

import numpy as np
import pyarrow as pa
from tests.llm import edge

from vacanta.llm import substring_dedup as sub
from vacanta.llm import text


def brute(rows):
    first = {}
    split = [(d, edge.SPACE.findall(x or "")) for d, x in rows]
    for d, w in split:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = Counter()
    for d, w in split:
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for j in range(i, i + 13)}
        out[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    return out


def corpus(seed=3):
    rnd = random.Random(seed)
    v = [f"w{i}" for i in range(50)]
    passage = [rnd.choice(v) for _ in range(60)]
    rows = []
    for d in range(100, 180):
        w = rnd.choices(v, k=rnd.randint(0, 60))
        if d % 3:
            a = rnd.randrange(40)
            w[len(w) // 2 : len(w) // 2] = passage[a : a + rnd.randint(5, 30)]
        if d % 10 == 0:
            w = ["a", "b"] * rnd.randint(1, 300)
        rows.append((d, " \n".join(w)))
    return rows + [(i, rows[i - 200][1]) for i in range(200, 220)]


def test_against_brute_force(spark):
    docs = edge.documents(spark, corpus()).repartition(4)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    for edges in ((), (0.3,), (0.2, 0.4, 0.6), (0.1, 0.3, 0.5, 0.7, 0.9)):
        assert Counter(map(tuple, sub.dedup(docs, edges=edges).collect())) == want
    assert any(n for _, _, n, _ in want)


def test_runs_and_compaction(spark):
    rows = corpus(9)
    docs = edge.documents(spark, rows)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    index, found = sub.Index(5), None
    for low, high in ((0, 50), (50, 120), (120, 150), (150, 999)):
        part, index = sub.add(index, docs.filter(f"doc_id >= {low} and doc_id < {high}"))
        found = part if found is None else found.unionByName(part)
        if len(index.runs) == 3:
            index = sub.compact(index)
            assert len(index.runs) == 1
    assert len(index.runs) == 2
    assert Counter(map(tuple, sub.remove(docs, found, 5).collect())) == want


def test_windows_around_one_phrase_that_agree_in_32_bits(spark):
    rnd = random.Random(5)
    hashed = lambda texts: text.words(pa.array(texts), text.NOT_SPACE, False).hash
    phrases = [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(4)) for _ in range(100_000)]
    phrase = phrases[int(np.argmin(text.runs(hashed(phrases), 4, 11)[::4]))]
    texts = [phrase + "".join(f" w{rnd.randrange(10**6)}" for _ in range(9)) for _ in range(250_000)]
    full = text.runs(hashed(texts), 13)[::13]
    order = np.argsort(full & np.uint64(0xFFFFFFFF))
    low = full[order] & np.uint64(0xFFFFFFFF)
    pairs = [(texts[order[i]], texts[order[i + 1]]) for i in np.flatnonzero(low[1:] == low[:-1])]
    pairs = [p for p in pairs if len(set(sub.entries(pa.array(p))[0].tolist())) == 1]
    assert pairs
    rows = [(i, x) for i, x in enumerate(x for p in pairs for x in p)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for edges in ((), (0.5,)):
        assert Counter(map(tuple, sub.dedup(docs, edges=edges).collect())) == brute(rows)


def test_two_texts_of_one_document(spark):
    first, other = " ".join(f"w{i}" for i in range(13)), " ".join(f"x{i}" for i in range(20))
    rows = [(1, first), (2, first), (2, other), (2, other), (3, other + " end"), (None, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute([r for r in rows if r[0]]) + Counter({(None, 13, 0, first): 1})
    for edges in ((), (0.5,)):
        assert Counter(map(tuple, sub.dedup(docs, edges=edges).collect())) == want


def test_empty(spark):
    assert sub.dedup(edge.empty(spark)).count() == 0
