import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import edge

from vacanta.llm import resampling
from vacanta.llm.shared import written


def brute(docs, target, percent=10, run=1, buckets=resampling.BUCKETS, least=resampling.LEAST_WORDS, seed=resampling.SEED):
    def features(text):
        w = edge.LETTERS.findall(edge.lower(text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + r]).encode()) % buckets for r in range(1, run + 1) for i in range(len(w) - r + 1)]

    made = [(d, *features(x)) for d, x in docs]
    s = Counter(b for _, _, f in made for b in f)
    t = Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    rows = []
    for d, w, f in made:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranked = [(*r[:1], *r[2:], i) for i, r in enumerate(order[: percent * len(order) // 100], 1)]
    left = Counter((*r[:1], *r[2:]) for r in rows) - Counter(r[:-1] for r in ranked)
    return Counter(ranked) + Counter({(*r, None): n for r, n in left.items()})


def rows(df):
    return Counter(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()))


@pytest.mark.parametrize(("run", "percent", "chunk"), [(1, 30, 4), (3, 50, 1 << 20), (2, 100, 1), (1, 0, 4)])
def test_edges(spark, run, percent, chunk):
    long = " ".join(f"Word{i} café" for i in range(20))
    extra = [(20 + i, f"{long} {'seven ' * (i % 5)}") for i in range(30)] + [(None, long), (None, long + " x"), (40, f"{long} ")] + [(77, "w" * 100 + " " + long)] * 4
    docs = edge.documents(spark, extra).repartition(3)
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = spark.createDataFrame([(1, "café word3 seven"), (2, None), (2, "w" * 100)], "item_id long, text string")
    got = resampling.resample(docs, target, percent, run=run, buckets=50, chunk=chunk)
    assert rows(got) == brute(texts, [r["text"] for r in target.collect()], percent, run, 50)


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(resampling.resample(edge.empty(spark), none)) == Counter()
    docs = edge.documents(spark)
    assert rows(resampling.resample(docs, none, 100)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [], 100)


@pytest.mark.parametrize("values", [list(range(500)), [7] * 300 + [9] * 3, [(i * 7919) % 101 - 50 for i in range(900)], [-(1 << 62), 1 << 62, 0]])
def test_cutoff(spark, values):
    table = written(spark.createDataFrame([(v,) for v in values], "x long").repartition(5), "values")
    down = sorted(values, reverse=True)
    for k in sorted({1, 2, len(values) // 3 + 1, len(values)}):
        assert resampling.cutoff(table, k, 16) == (down[k - 1], sum(v > down[k - 1] for v in values))


def test_a_round_discards_a_quarter():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(-(10**9), 10**9, 5000))
    chunks = np.split(values, [3, 500, 520, 4000])
    pivot = resampling.weighted_median([(n, m) for c in chunks for _, n, m in resampling.sides(c, None)])
    assert min((values >= pivot).sum(), (values <= pivot).sum()) >= len(values) // 4


def test_crc32():
    words = [b"", b"a", "größe".encode(), b"x" * 64, b"y" * 65, b"z" * 1000]
    data = np.frombuffer(b"".join(words), np.uint8)
    last = np.cumsum([len(w) for w in words])
    assert resampling.crc32(data, last - [len(w) for w in words], last).tolist() == [zlib.crc32(w) for w in words]


def test_noise_is_the_same_for_any_order(spark):
    docs = edge.documents(spark).filter(F.col("doc_id") < 9)
    none = spark.createDataFrame([("x",)], "text string")
    assert rows(resampling.resample(docs.orderBy(F.desc("doc_id")), none, 50)) == rows(resampling.resample(docs, none, 50))
