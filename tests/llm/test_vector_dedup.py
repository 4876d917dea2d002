from collections import Counter

import numpy as np

from vacanta.llm import vector_dedup


def brute(rows):
    ok = [i for i, (_, x) in enumerate(rows) if x and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ok:
        for j in ok:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, links[i], least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, "z") for i, x in rows], "vec_id long, embedding array<float>, label int, rep string").repartition(3)


def test_against_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    rows = []
    for c in range(40):
        centre = rnd.normal(size=16)
        for _ in range(int(rnd.integers(1, 12))):
            rows.append((len(rows), (centre + rnd.normal(size=16) * 0.15).astype(np.float32).tolist()))
    rows += [(1000 + i, rows[5][1]) for i in range(30)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, [float("nan")] * 16), (2005, [float("inf")] + [0.0] * 15), (2006, [1e30] * 16), (2007, [1e-30] * 16), (2008, [1.0, 2.0]), (2009, [1.0, 2.1]), (5, rows[5][1])]
    want = brute(rows)
    for block in (1024, 80):
        monkeypatch.setattr(vector_dedup, "BLOCK", block)
        assert Counter(map(tuple, vector_dedup.link(frame(spark, rows)).collect())) == want


def test_recall_over_many_vectors(spark):
    rnd = np.random.default_rng(8)
    base = rnd.normal(size=(3000, 32))
    near = base[:600] + rnd.normal(size=(600, 32)) * 0.4
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(np.concatenate([base, near]))]
    want = sum(n for _, n, _, _ in brute(rows).elements())
    got = vector_dedup.link(frame(spark, rows), window=16).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * want <= got <= want and want > 200


def crowd(shared, hot, n=6000, pairs=900, d=32):
    """Vectors of mean cosine `shared` in the first `hot` of them, each of the last near one of those before."""
    rnd = np.random.default_rng(9)
    base = rnd.normal(size=(n, d))
    base /= np.linalg.norm(base, axis=1)[:, None]
    axis = rnd.normal(size=d)
    axis /= np.linalg.norm(axis)
    some = int(n * hot)
    base[:some] = base[:some] * np.sqrt(1 - shared) + axis * np.sqrt(shared)
    base /= np.linalg.norm(base, axis=1)[:, None]
    of = rnd.choice(some, pairs, replace=False)
    off = rnd.normal(size=(pairs, d))
    off -= (off * base[of]).sum(1)[:, None] * base[of]
    off /= np.linalg.norm(off, axis=1)[:, None]
    near = base[of] * 0.905 + off * np.sqrt(1 - 0.905**2)
    return [(i, x.astype(np.float32).tolist()) for i, x in enumerate(np.concatenate([base, near]))]


def recall(spark, rows):
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = int(((x @ x.T) >= 0.9).sum()) - len(x)
    got = vector_dedup.link(frame(spark, rows), window=16).agg({"n_links": "sum"}).first()[0]
    assert want > 1500 and got <= want
    return got / want


def test_recall_with_a_common_direction(spark):
    assert recall(spark, crowd(0.6, 1)) >= 0.96


def test_recall_with_a_hot_third(spark):
    assert recall(spark, crowd(0.7, 1 / 3)) >= 0.96


def test_empty(spark):
    assert vector_dedup.link(frame(spark, [(1, [1.0])]).limit(0)).count() == 0
    assert [tuple(r) for r in vector_dedup.link(frame(spark, [(1, None)])).collect()] == [(1, 0, 1, True)]
