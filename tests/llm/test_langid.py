import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np

from sylva.llm import langid as m

PARTS = {"en": "the and ing tion er that with".split(), "de": "sch ung der ein keit und ü".split(), "fr": "eau ment les é ai qui oi".split()}


def rows(rng, n):
    out = []
    for i in range(n):
        lang = rng.choice([*PARTS])
        out.append((i, " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(5, 80))), lang))
    return out


def test_counts_of_blocks(monkeypatch):
    text = "".join(random.Random(1).choice("abc dÉ1,日") for _ in range(1000))
    whole = m.counts(text)
    assert whole.sum() > 2000
    assert m.counts("12 !?") is None and m.counts("") is None
    monkeypatch.setattr(m, "BLOCK", 100)
    assert abs(m.counts(text) - whole).sum() <= 0.05 * whole.sum()  # a few n-grams at edges differ


def test_folding():
    assert "".join(map(chr, m.fold("Ab1 -Ç日\n"))) == " ab ç日 "


def test_held_out_accuracy(spark):
    data = rows(random.Random(2), 400)
    docs = spark.createDataFrame(data + [(1000, None, "en"), (1001, "text", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in m.predict(docs, m.learn(docs)).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in data if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.97
    assert got[1000].lang_pred == "und" and got[1000].score == 0


def test_models_are_equal_however_rows_lie(spark):
    data = rows(random.Random(3), 120)
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    a, b = m.fit(docs.coalesce(1)), m.fit(docs.repartition(7))
    assert a.langs == b.langs and np.array_equal(a.centroids, b.centroids)


def test_sample_is_bounded(spark):
    data = rows(random.Random(4), 600)
    model = m.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), sample=20, centroids=2)
    assert model.langs == ["de", "en", "fr"] and len(model.centroids) == 6


def grams(text):
    """Counts of buckets, n-gram by n-gram, in integers of Python."""
    mask, out = (1 << 64) - 1, Counter()
    x = " " + "".join(c.lower() if unicodedata.category(c)[0] == "L" else " " for c in text) + " "
    x = [ord(c) for c in re.sub(" +", " ", x)]
    for n in (1, 2, 3):
        for i in range(len(x) - n + 1):
            one = [c * 0x9E3779B97F4A7C15 for c in x[i : i + n]]
            h = one[0]
            if n > 1:
                h = one[0] * 3 + one[1] * 5
            if n > 2:
                h = h * 7 + one[2] * 11
            out[((h + n - 1) * 0xC2B2AE3D27D4EB4F & mask) >> 51] += 1
    return out


def test_against_brute_force(spark):
    """The nearest of all centroids by cosine, one text and centroid at a time, and what lies too far from them."""
    rng = random.Random(7)
    data = rows(rng, 150) + [(1000, "日本語の文章", None), (1001, "Привет мир", None), (1002, "zzzz qqqq xxxx", None), (1003, "a", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = m.learn(docs)
    got = {r.doc_id: r for r in m.predict(docs, model, 0.8).collect()}
    idf = model.idf.astype(float)
    for i, text, _ in data:
        v = {b: math.log1p(n) * idf[b] for b, n in grams(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[b]) for b, x in v.items()) / norm for c in model.centroids]
        best = max(cosines)
        assert abs(got[i].score - max(0, best)) < 1e-5 and abs(got[i].distance - 1 + got[i].score) < 1e-5
        near = {model.langs[model.of[k]] for k, c in enumerate(cosines) if c > best - 1e-6}
        assert got[i].lang_pred in near and got[i].rejected == (got[i].distance > 0.8)
    assert got[1000].rejected and got[1001].rejected
    assert {r.doc_id for r in m.keep(docs, model, 0.8).collect()} == {i for i, r in got.items() if not r.rejected}


def test_dirty_languages(spark):
    """Of many labels those with most documents are learned."""
    data = rows(random.Random(5), 300) + [(1000 + i, "the and ing", f"dirt{i}") for i in range(50)]
    model = m.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), languages=3)
    assert model.langs == ["de", "en", "fr"]


def test_odd(spark, odd, clashing, empty):
    model = m.learn(odd)
    for df in (odd, clashing):
        got = m.predict(df, model).collect()
        assert len(got) == df.count()
        assert all((r.lang_pred == "und") == (r.doc_id in (1, 2, 3, -8)) and 0 <= r.score <= 1 for r in got)
    kept = m.keep(clashing, model, 2.0)
    assert kept.columns == clashing.columns and kept.count() == clashing.count() - 4
    assert m.keep(clashing, model, -1.0).count() == 0
    none = m.fit(empty)
    assert m.predict(empty, model).count() == 0 and {r.lang_pred for r in m.predict(odd, none).collect()} == {"und"}
