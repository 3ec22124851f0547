"""Language identification by nearest centroids of character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, hash_third, read

#: Buckets of hashed n-grams of 1 to 3 characters.
DIMS = 1 << 13
#: Code points whose n-grams are counted at once, the bound of a worker's memory in very long texts.
BLOCK = 1 << 18
#: Documents of each language, and of all, that centroids are fitted on at most (in expectation; drawn by a hash of the id).
SAMPLE, TOTAL = 600, 12_000
#: Languages that are learned at most: those with most documents. The others' labels are taken for dirt.
LANGUAGES = 256
CENTROIDS = 3
ROUNDS = 12
SEED = 5
#: Cosine distance to the nearest centroid above which a text's language counts as none of those learned.
REJECT = 0.85
UNDETERMINED = "und"


def _folding() -> np.ndarray:
    """For each code point of the Basic Multilingual Plane its lower case if a letter, else a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        s = chr(c)
        if unicodedata.category(s)[0] == "L":
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_fold: list[np.ndarray] = []


def fold(text: str) -> np.ndarray:
    """Lower-case letters as code points; runs of anything else as one space, one at either end."""
    if not _fold:
        _fold.append(_folding())
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    high = x > 0xFFFF
    y = _fold[0][np.where(high, 0, x)]
    if high.any():
        y[high] = [c if unicodedata.category(chr(c))[0] == "L" else 32 for c in x[high].tolist()]
    y = np.concatenate([[np.uint32(32)], y, [np.uint32(32)]])
    keep = np.ones(len(y), bool)
    keep[1:] = (y[1:] != 32) | (y[:-1] != 32)
    return y[keep]


def counts(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams occur in the whole text; None if it has no letter."""
    out, letters = np.zeros(DIMS, np.float32), False
    for at in range(0, max(1, len(text)), BLOCK):
        x = fold(text[max(0, at - 2) : at + BLOCK]).astype(np.uint64)  # n-grams over an edge are in the later block
        letters |= bool((x != 32).any())
        one = x * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] * np.uint64(3) + one[1:] * np.uint64(5)
        three = two[:-1] * np.uint64(7) + one[2:] * np.uint64(11)
        for k, h in enumerate((one, two, three)):
            h = (h + np.uint64(k)) * np.uint64(0xC2B2AE3D27D4EB4F)
            out += np.bincount((h >> np.uint64(51)).astype(np.int64), minlength=DIMS)
    return out if letters else None


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    langs: list[str]
    of: np.ndarray  # the language of each centroid, as an index of langs

    def vectors(self, c: np.ndarray) -> np.ndarray:
        v = np.log1p(c) * self.idf
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=v, where=n > 0)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and cosine of the nearest centroid; und and 0 for texts without letters and if nothing was learned."""
        found = [None if t is None else counts(t) for t in texts]
        rows = [i for i, c in enumerate(found) if c is not None]
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if rows and len(self.langs):
            cosine = self.vectors(np.stack([found[i] for i in rows])) @ self.centroids.T
            best = cosine.argmax(1)
            for i, b, s in zip(rows, best.tolist(), cosine[np.arange(len(rows)), best].tolist(), strict=True):
                langs[i], scores[i] = self.langs[self.of[b]], min(1.0, max(0.0, round(s, 6)))
        return langs, scores


def cluster(v: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means of unit rows; fewer rows than k give a centroid each."""
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(ROUNDS):
        near = (v @ c.T).argmax(1)
        c = np.stack([v[near == i].sum(0) if (near == i).any() else c[i] for i in range(len(c))])
        n = np.linalg.norm(c, axis=1, keepdims=True)
        c = np.divide(c, n, out=c, where=n > 0)
    return c


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, languages: int = LANGUAGES) -> Model:
    """A model of the languages of documents(doc_id, text, lang) with text and lang: of those with most documents, `languages`
    at most, ties by name.

    About `sample` documents of each language (fewer if that makes more than TOTAL), drawn by a hash of the id, are
    counted where they lie; only their sparse counts come to the driver, which holds those and the dense vectors of one
    language at a time. Texts without letters and null languages teach nothing; without any, the model predicts und.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("doc_id"), "text", "lang")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    each = min(sample, TOTAL // max(1, len(sizes)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    limit = F.lit(0).cast("long")
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, min(1 << 30, int(each / n * (1 << 30)) + 1)).otherwise(limit)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            langs, where, values = [], [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = counts(text.as_py())
                if c is not None:
                    at = np.flatnonzero(c)
                    langs.append(lang)
                    where.append(at.astype("<u2").tobytes())
                    values.append(c[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(where, pa.binary()), pa.array(values, pa.binary())], names=["lang", "at", "n"])

    batches(docs.sparkSession)
    rows = known.filter(draw < limit).select("lang", "text").mapInArrow(run, "lang string, at binary, n binary").collect()
    of_lang: dict[str, list] = {}
    documents = np.zeros(DIMS, np.int64)
    for r in sorted(rows, key=lambda r: (r.lang, bytes(r.at), bytes(r.n))):  # rows may arrive in any order
        of_lang.setdefault(r.lang, []).append((np.frombuffer(r.at, "<u2"), np.frombuffer(r.n, "<f4")))
        documents[of_lang[r.lang][-1][0]] += 1
    model = Model(np.log((1 + len(rows)) / (1 + documents)).astype(np.float32) + 1, np.zeros((0, DIMS), np.float32), [], np.zeros(0, int))
    rng, found, of = np.random.default_rng(SEED), [], []
    for lang, texts in sorted(of_lang.items()):
        c = np.zeros((len(texts), DIMS), np.float32)
        for i, (at, n) in enumerate(texts):
            c[i, at] = n
        own = cluster(model.vectors(c), centroids, rng)
        of += [len(model.langs)] * len(own)
        model.langs.append(lang)
        found.append(own)
    if found:
        model.centroids, model.of = np.concatenate(found).astype(np.float32), np.array(of)
    return model


PREDICTED = "doc_id long, lang_pred string, score double, distance double, rejected boolean"


def predict(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """documents(doc_id, text) as PREDICTED; score is the cosine of the nearest centroid, distance 1 less that.

    A text further than `reject` from all centroids is rejected: its language counts as none of those learned, though
    lang_pred still names the nearest. lang_pred is und, score 0, distance 1 and the text rejected if it is null or has no
    letter. Repeated rows and null ids are kept, other columns ignored, an empty table gives an empty one. The model, a few
    centroids for each of at most LANGUAGES languages, goes to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            langs, scores = shared.value.predict(b.column(1).to_pylist())
            far = [round(1 - s, 6) for s in scores]
            gone = [lang == UNDETERMINED or d > reject for lang, d in zip(langs, far, strict=True)]
            columns = [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.float64()), pa.array(gone, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PREDICTED.split(", ")])

    batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PREDICTED)


def keep(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of documents, with all their columns, that predict() doesn't reject."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            langs, scores = shared.value.predict(b.column(at).to_pylist())
            yield b.filter(pa.array([lang != UNDETERMINED and round(1 - s, 6) <= reject for lang, s in zip(langs, scores, strict=True)], pa.bool_()))

    batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def learn(docs: DataFrame) -> Model:
    """The model learned on the documents that aren't held out."""
    return fit(docs.filter(hash_third(F.col("doc_id")) != 1))


def op8_language(spark, sf_dir) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    p = predict(docs, learn(docs))
    return p.select("doc_id", (hash_third(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "distance", "rejected")
