import random
import zlib

import numpy as np

from sylva.llm import quality as m


def texts(rng, n):
    good = lambda: " ".join(rng.choice("the of and river stone walks quietly, under trees.".split()) for _ in range(rng.randrange(20, 200)))
    bad = [lambda: " ".join(w + rng.choice(("###", "%%%", "&&&")) for w in good().split()), lambda: good().upper() + "!!", lambda: " | ".join(good().split())]
    return [(i, good(), 1) if rng.random() < 0.7 else (i, rng.choice(bad)(), 0) for i in range(n)]


def test_held_out_accuracy(spark):
    rows = texts(random.Random(1), 600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = m.learn(docs, labels)
    assert model.rules
    held = [r for r in m.score(docs, model, ["doc_id"]).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    truth = {r[0]: r[2] for r in rows}
    assert len(held) > 100 and np.mean([(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in held]) > 0.97


def test_held_out_labels_teach_nothing(spark):
    rows = texts(random.Random(2), 200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flip = lambda i, q: 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q
    a, b = (m.learn(docs, spark.createDataFrame([(r[0], f(r[0], r[2])) for r in rows], "doc_id long, quality int")) for f in (lambda i, q: q, flip))
    assert a == b


def test_compiled_rules_equal_numpy(spark):
    rows = texts(random.Random(3), 150)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = m.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int"))
    x = np.array([list(r.s) for r in m.with_statistics(docs, ["doc_id"]).orderBy("doc_id").collect()])
    z = model.intercept + m.holds(x, [r for r, _ in model.rules]) @ np.array([w for _, w in model.rules])
    got = [r.score for r in m.score(docs, model, ["doc_id"]).orderBy("doc_id").collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-z)))


def test_repeated_ids_teach_once(spark):
    rows = texts(random.Random(4), 150)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    assert m.fit(docs, labels) == m.fit(docs.union(docs).union(docs), labels.union(labels))


def test_lasso_is_optimal():
    rng = np.random.default_rng(0)
    r = (rng.random((300, 12)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1])))).astype(float)
    b, w = m.lasso(r, y, 0.02, 5000)
    g = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
    assert np.all(np.abs(g[w == 0]) <= 0.02 + 1e-6) and np.allclose(g[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-5) and (w == 0).any()


def test_odd(spark, odd, clashing, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 140)] + [(6, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    model = m.fit(odd, labels)
    for df in (odd, clashing):
        rows = m.score(df, model, ["doc_id"]).collect()
        assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert m.score(clashing, model, clashing.columns[:5]).columns == [*clashing.columns[:5], "score"]
    assert m.score(empty, model, ["doc_id"]).count() == 0
    none = m.fit(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert not none.rules and {r.score for r in m.score(odd, none, ["doc_id"]).collect()} == {0.5}
    one = m.fit(odd, spark.createDataFrame([(i, 1) for i in range(100, 140)], "doc_id long, quality int"))
    assert {r.score >= 0.5 for r in m.score(odd, one, ["doc_id"]).collect()} == {True}
