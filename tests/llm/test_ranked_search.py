import math
from collections import Counter

import numpy as np
import pytest
from tests.llm import edge

from vacanta.llm import ranked_search
from vacanta.llm.ranked_search import Best, Lists


def brute(docs, items, k=20):
    made = [(d, Counter(edge.LETTERS.findall(edge.lower(x or "")))) for d, x in docs]
    made = [(d, c, c.total()) for d, c in made if c]
    n, total = len(made), sum(size for _, _, size in made)
    df = Counter(t for _, c, _ in made for t in c)
    out = Counter()
    for item, x in items:
        terms = edge.LETTERS.findall(edge.lower(x or ""))
        scores = []
        for d, c, size in made:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms)
            scores.append((-s, d is None, d or 0, d))
        for i, (s, _, _, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1):
            out[item, i, d, -s] += 1
    return out


def rows(df):
    return Counter(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


@pytest.mark.parametrize(("k", "block", "entries"), [(20, 1 << 20, 1 << 20), (3, 40, 1 << 20), (5, 200, 10), (1, 1, 1)])
def test_against_brute_force(spark, k, block, entries):
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(60)] + ["Öl", "tie"]
    weight = 1 / np.arange(1, len(names) + 1)
    texts = [" ".join(rng.choice(names, rng.integers(1, 40), p=weight / weight.sum())) for _ in range(150)]
    extra = [(100 + i, x) for i, x in enumerate(texts)] + [(300 - i, "tie tie w59") for i in range(30)] + [(None, "tie tie w59"), (None, "W1 öl")]
    docs = edge.documents(spark, extra).repartition(4)
    items = [(1, "tie"), (2, "w1 w1 W2, w3 w40"), (3, None), (4, ""), (5, "absent"), (6, "the Öl öl one"), (6, "w7"), (None, "w1 w5"), (7, " ".join(texts[:3])), (8, "ein five end x")]
    asked = spark.createDataFrame([(i, x, 1) for i, x in items], "item_id long, text string, number int")
    got = ranked_search.rank(docs, asked, k=k, block_bytes=block, entries_most=entries)
    assert rows(got) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], items, k)


def test_empty(spark):
    items = spark.createDataFrame([("a", "one two")], "item_id string, text string")
    assert rows(ranked_search.rank(edge.empty(spark), items)) == Counter()
    assert rows(ranked_search.rank(edge.documents(spark), items.limit(0))) == Counter()
    assert rows(ranked_search.rank(edge.documents(spark), items, k=2)) == brute([(r["doc_id"], r["text"]) for r in edge.documents(spark).collect()], [("a", "one two")], 2)


def lists(own):
    """own: for each document its (term, impact)."""
    doc, term, impact = (np.array(x, np.int64) for x in zip(*[(d, t, i) for d, e in enumerate(own) for t, i in sorted(e)], strict=True))
    return Lists(doc, term, impact, len(own), int(term.max()) + 1)


def test_best_positions_stop_early(monkeypatch):
    monkeypatch.setattr(ranked_search, "STEP", 1)
    # The documents at the top of one list are at the top of the other, in reverse: direct access sees both tops at once.
    own = [[(0, 1000 - i), (1, 901 + i)] for i in range(100)] + [[(0, 10), (1, 10)]] * 5000
    found, best = lists(own), Best(1, 5)
    read = found.search(np.array([0, 1]), np.array([1, 1]), 0, best, np.zeros(len(own), np.int64), np.arange(len(own)))
    assert best.rows[0][0].tolist() == [1901] * 5 and best.rows[0][2].tolist() == [0, 1, 2, 3, 4]
    assert read < 300 and not found.met.any() and not found.seen.any() and not found.gain.any()


def test_does_not_stop_at_equal(monkeypatch):
    monkeypatch.setattr(ranked_search, "STEP", 1)
    own = [[(0, 50)] for _ in range(64)]
    best = Best(1, 1)
    lists(own).search(np.array([0]), np.array([3]), 0, best, np.zeros(64, np.int64), np.arange(64)[::-1].copy())
    assert (best.rows[0][0].tolist(), best.rows[0][2].tolist()) == ([150], [0])
