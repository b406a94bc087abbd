import zlib

import numpy as np
from pyspark.sql import functions as F

from hedgerow.llm import toxicity


def test_pairs_count_beyond_their_parts():
    """Label 1 for an insult with a group, not for either alone: a linear model can't."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(4000):
        insult, group = (rng.random(2) < 0.4).tolist()
        words = [f"w{int(x)}" for x in rng.integers(0, 300, 20)] + ["insult"] * insult + ["group"] * group
        rows.append(toxicity.terms_of(" ".join(words)))
        y.append(float(insult and group))
    y = np.array(y)
    m = toxicity.fit(rows[:3000], y[:3000])
    places = [toxicity.kept_places(m.terms, t) for t in rows[3000:]]
    z = toxicity._sums(m.bias, m.weights, m.factors, np.concatenate(places), np.cumsum([len(p) for p in places]))[0]
    assert ((z > 0) == (y[3000:] == 1)).mean() > 0.97


def tables(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(1500):
        toxic = rng.random() < 0.15
        words = [f"w{int(x)}" for x in rng.integers(0, 500, 60)]
        if toxic:
            words.insert(int(rng.integers(60)), "Nasty")
        docs.append((i, " ".join(words), float(i)))
        labels.append((i, int(toxic)))
    docs += [(2000, None, 0.0), (2001, "", 0.0), (2002, "nasty " + "x " * 50000, 0.0), (2003, "same", 0.0), (2003, "same", 0.0), (None, "nasty", 0.0)]
    labels += [(None, 1), (5, None), (99999, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_edges(spark):
    docs, labels = tables(spark)
    model = toxicity.learn(docs, labels)
    rows = toxicity.scored(docs, model).join(labels.dropna(), "doc_id", "left").select("*", toxicity.held_out().alias("held")).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held and r.toxic is not None]
    assert len(held) > 200 and np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in held]) > 0.98
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    by = {r.doc_id: r.score for r in rows}
    assert by[2000] == by[2001] < 0.5 < by[2002] and all(0 <= r.score <= 1 for r in rows)
    again = toxicity.learn(docs.repartition(3), labels.repartition(2))
    assert np.allclose(again.weights, model.weights) and again.bias == model.bias


def test_held_out_labels_teach_nothing(spark):
    docs, labels = tables(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(docs, labels).bias == toxicity.learn(docs, flipped).bias


def test_one_class_and_empty(spark):
    docs, labels = tables(spark)
    for x, share in ((labels.filter("toxic = 0"), 0), (labels.filter("toxic = 1"), 1), (labels.limit(0), 0)):
        scores = {round(r.score, 4) for r in toxicity.scored(docs, toxicity.learn(docs, x)).collect()}
        assert scores == {share}
    assert toxicity.scored(docs.limit(0), toxicity.learn(docs.limit(0), labels)).collect() == []


def test_sums_and_slopes_equal_a_naive_machine():
    rng = np.random.default_rng(3)
    w, v = rng.normal(size=9), rng.normal(size=(9, toxicity.FACTORS))
    runs = [np.sort(rng.choice(9, n, replace=False)) for n in (0, 1, 4, 9, 2)]
    flat, lengths = np.concatenate(runs), np.array([len(r) for r in runs])
    naive = lambda w, v: np.array([0.3 + sum(w[i] for i in r) + sum(v[i] @ v[j] for a, i in enumerate(r) for j in r[a + 1 :]) for r in runs])
    z, first = toxicity._sums(0.3, w, v, flat, np.cumsum(lengths))
    assert np.allclose(z, naive(w, v))
    loss = rng.normal(size=len(runs))
    u, dw, dv = toxicity._slopes(v, flat, lengths, first, loss)
    for n, i in enumerate(u.tolist()):
        up = w.copy()
        up[i] += 1e-6
        assert abs((loss @ (naive(up, v) - naive(w, v))) / 1e-6 - dw[n]) < 1e-4
        for k in range(toxicity.FACTORS):
            up = v.copy()
            up[i, k] += 1e-6
            assert abs((loss @ (naive(w, up) - naive(w, v))) / 1e-6 - dv[n, k]) < 1e-4


def test_pairs_of_words_that_are_equally_common_in_both_classes():
    """Toxic with both words or with neither, clean with one of them: each word is in half of either class's texts."""
    rng = np.random.default_rng(6)
    rows, y = [], []
    for _ in range(6000):
        a, b = (rng.random(2) < 0.5).tolist()
        words = [f"w{int(x)}" for x in rng.integers(0, 400, 30)] + ["they"] * a + ["leave"] * b
        rows.append(toxicity.terms_of(" ".join(words)))
        y.append(float(a == b))
    y = np.array(y)
    m = toxicity.fit(rows[:5000], y[:5000])
    places = [toxicity.kept_places(m.terms, t) for t in rows[5000:]]
    z = toxicity._sums(m.bias, m.weights, m.factors, np.concatenate(places), np.cumsum([len(p) for p in places]))[0]
    assert ((z > 0) == (y[5000:] == 1)).mean() > 0.95


def test_the_sample_is_bounded_by_its_terms(spark, monkeypatch):
    docs, labels = tables(spark)
    monkeypatch.setattr(toxicity, "SAMPLE_TERMS", 2000)
    rows = toxicity.sample(docs, labels, "toxic").collect()
    for y in (0, 1):
        assert 1900 < sum(r.n for r in rows if r.y == y) <= 2000
    assert all(len(r.terms) == 4 * r.n for r in rows)
