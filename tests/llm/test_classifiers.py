import random

import numpy as np
import pyarrow as pa
from tests.llm import edge

from vacanta.llm import quality, samples, toxicity


def corpus(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdeghimnorstu") for _ in range(rnd.randint(2, 9)))
    docs, labels = [], []
    for d in range(600):
        w = [word() for _ in range(rnd.randint(20, 120))]
        bad, toxic = d % 4 == 0, d % 5 == 1
        if bad:
            w = [x.upper() + "!!" for x in w] if d % 8 else [x for x in w[:9] for _ in range(8)]
        if toxic:
            for i in range(0, len(w), 15):
                x = rnd.choice(["zarkwad", "blenfous"])
                w[i] = x[:3] + x[4:] if rnd.random() < 0.3 else x
        docs.append((d, " ".join(w)))
        labels.append((d, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels}


def test_quality(spark):
    docs, labels, truth = corpus(spark)
    model = quality.train(docs, labels.filter(samples.bucket("doc_id", 4) != 2))
    rows = quality.score(docs, model).withColumn("held", samples.bucket("doc_id", 4) == 2).collect()
    held = [r for r in rows if r["held"]]
    assert np.mean([(r["score"] >= 0.7) == truth[r["doc_id"]][0] for r in held]) > 0.97
    got = quality.score(edge.documents(spark), model).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(edge.empty(spark), model).count() == 0


def test_quality_cut_does_not_move_with_the_sample(spark):
    docs, labels, truth = corpus(spark)
    noisy = labels.selectExpr("doc_id", "if(doc_id % 11 = 0, 1 - quality, quality) as quality")
    model = quality.train(docs, noisy, most=(60, 60))
    share = noisy.filter("quality = 0").count() / noisy.count()
    kept = quality.score(docs, model).filter("score >= 0.7").count()
    assert abs(kept / 600 - (1 - share)) < 0.01
    x = model.value(quality.measures(pa.array([r["text"] for r in docs.collect()])))
    assert abs(model.cut - np.quantile(x, share, method="midpoint")) < 1e-6
    whole = quality.train(docs, noisy)
    assert abs(quality.cut_of(docs, samples.known(noisy, "quality"), whole) - whole.cut) < 1e-9


def test_toxicity(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.train(docs, labels.filter(samples.bucket("doc_id", 5) != 0))
    rows = toxicity.predicted(toxicity.score(docs, model)).withColumn("held", samples.bucket("doc_id", 5) == 0).collect()
    held = [r for r in rows if r["held"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) > 0.93
    # spellings that no text has
    assert (model.score(pa.array(["a zarkwaad in the garden", "some blennfous here again"])) > 0.5).all()
    got = toxicity.score(edge.documents(spark), model).collect()
    assert len(got) == 11 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (2, 3, 4)} == {0.0}


def test_repeated_rows_score_alike(spark):
    docs, labels, _ = corpus(spark)
    odd = edge.documents(spark)
    for scored in (quality.score(odd, quality.train(docs, labels)), toxicity.score(odd, toxicity.train(docs, labels))):
        by_id = {}
        for r in scored.collect():
            by_id.setdefault(r["doc_id"], []).append(r["score"])
        assert by_id[1] == by_id[5] and len(by_id[10]) == 2 and len(set(by_id[10])) == 1


def test_no_labels(spark):
    docs, labels, _ = corpus(spark)
    for none in (labels.limit(0), labels.filter("quality = 1 and toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) quality", "cast(null as int) toxic")):
        assert quality.train(docs, none) is None and toxicity.train(docs, none) is None
    assert {r["score"] for r in quality.score(docs, None).collect()} == {1.0}
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_measures_of_odd_texts():
    x = quality.measures(pa.array([None, "", "  ", "a", "!!", "word " * 5]))
    assert np.isfinite(x).all() and len(x) == 6
