import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as c
from sylva.llm import langid, mixing, packing, quality
from sylva.llm.common import read

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's output, written and read again, after the documents themselves."""
    docs = read(spark, sf, "documents")
    out = {"documents": docs}
    for name, f in c.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, sf).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_columns(stages):
    for name in ("quality", "language", "near_dedup", "mixing"):
        assert stages[name].columns == stages["documents"].columns


def test_quality_keeps_what_scores(spark, sf, stages):
    docs = stages["documents"]
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.learn(docs, read(spark, sf, "labels")), ["doc_id"]).collect()}
    assert sorted(i for i, s in scores.items() if s >= 0.5) == sorted(r.doc_id for r in stages["quality"].collect())


def test_language_keeps_what_is_near(stages):
    docs = stages["quality"]
    got = {r.doc_id: r for r in langid.predict(docs, langid.learn(docs)).collect()}
    want = sorted(i for i, r in got.items() if r.lang_pred != "und" and not r.rejected)
    assert want == sorted(r.doc_id for r in stages["language"].collect())


def test_one_of_each_group(stages):
    """Groups by all pairs of texts; pairs within the estimate's error of the threshold may go either way."""
    docs = {r.doc_id: r.text.lower().split() for r in stages["language"].collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in docs.items()}
    kept = {r.doc_id for r in stages["near_dedup"].collect()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(docs)
    pairs = {(a, b): s for i, a in enumerate(ids) for b in ids[i + 1 :] if (s := like(a, b)) > 0.6}
    assert not [p for p, s in pairs.items() if s >= 0.86 and p[0] in kept and p[1] in kept]
    for i in set(ids) - kept:
        assert max(s for p, s in pairs.items() if i in p) >= 0.74


def test_mixture(stages):
    docs = stages["near_dedup"]
    want = Counter({r.doc_id: r.copies for r in mixing.mix(docs).collect()})
    assert Counter(r.doc_id for r in stages["mixing"].collect()) == +want


def test_packing_is_lossless(stages):
    t = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    ids = {}
    for r in stages["mixing"].dropDuplicates(["doc_id"]).collect():
        ids[r.doc_id] = np.array(t.encode(r.text, add_special_tokens=False).ids + [packing.END], "<u4")
    copies = Counter(r.doc_id for r in stages["mixing"].collect())
    tokens = Counter()
    for r in stages["packing"].collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        tokens[r.doc_id] += r.length
    assert tokens == Counter({i: n * len(ids[i]) for i, n in copies.items()})


def test_run(spark, sf, stages):
    got = c.run(spark, sf).agg(F.count("*"), F.sum("length")).first()
    assert got == stages["packing"].agg(F.count("*"), F.sum("length")).first()


def test_clashing_columns_and_nulls(spark, sf, odd):
    docs = odd.select("*", F.lit(1).alias("score"), F.lit("x").alias("row"), F.lit("y").alias("d"))
    for _, f in c.STAGES[:-1]:
        docs = f(spark, docs, sf)
        assert docs.columns == [*odd.columns, "score", "row", "d"]
        assert docs.count() >= 0
    assert c.STAGES[-1][1](spark, odd, sf).count() >= odd.count()
