"""SimHash near-dedup: fingerprints of word shingles, links by pigeonring filtering, components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import batches, broadcast_below, cut, read

SEED = 42
BITS = 64
#: Shingles whose bits are counted at once, the bound of a worker's memory in very long texts.
BLOCK = 1 << 16
#: Fingerprints in a bucket up to which its pairs are listed; above, neighbours meet at points one bit away.
PAIRS = 16

# --- fingerprints ---------------------------------------------------------------------------------------------------


def shingles(text: bytes, k: int) -> Iterator[bytes]:
    """Runs of k words, repeats included; fewer words give the whole sequence, none give nothing."""
    w = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if len(w) <= k:
        return iter([b" ".join(w)] if w else [])
    return map(b" ".join, zip(*(w[i:] for i in range(k)), strict=False))


def hashes(text: bytes, k: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles(text, k), repeat(SEED)), np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes give 0. As a signed 64-bit integer."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """(doc_id, fp) of documents(doc_id, text), by tasks over their own rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = [fingerprint(hashes(t.as_py(), k)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, fp long")


# --- pigeonring -----------------------------------------------------------------------------------------------------


def ring(segments: int) -> list[tuple[int, int]]:
    """(offset, width) of the segments of a fingerprint."""
    at = [BITS * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def segment(fp: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))


def chains(a: Column, b: Column, segments: int, radius: int) -> Column:
    """True if from some segment on, each run of l segments round the ring differs in at most l * radius / segments bits.

    If at most `radius` bits differ in all, such a start exists; so what fails here needs no full Hamming check.
    """
    d = [F.bit_count(segment(a.bitwiseXOR(b), *s)) for s in ring(segments)]
    starts = []
    for i in range(segments):
        total, within = F.lit(0), F.lit(True)
        for length in range(1, segments + 1):
            total = total + d[(i + length - 1) % segments]
            within = within & (total <= length * radius // segments)
        starts.append(within)
    out = starts[0]
    for s in starts[1:]:
        out = out | s
    return out


def links(fps: DataFrame, radius: int = 2, segments: int = 5) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fps(fp) at most `radius` (0 to 2) bits apart.

    `radius` bits touch at most `radius` segments, so the other segments are equal: each choice of them is a key, of 38 or
    39 bits at the defaults. Every choice holds a chain of neighbouring segments without difference, the start of a
    pigeonring chain, and pairs that share a key are pruned by the whole chain before the Hamming check. In buckets of
    more than PAIRS fingerprints no pairs are listed: their fingerprints and all points one bit away are grouped by
    point, where any two at most 2 bits apart meet, and at most 65 do.
    """
    if not 0 <= radius <= 2 < segments:
        raise ValueError("radius: 0 to 2, segments: 3 at least")
    parts, keys = ring(segments), []
    for table, chosen in enumerate(combinations(range(segments), segments - radius)):
        key, width = F.lit(table).cast("long"), 0
        for s in chosen:
            key = F.shiftleft(key, parts[s][1]).bitwiseOR(segment(F.col("fp"), *parts[s]))
            width += parts[s][1]
        keys.append(key if width < 58 else F.xxhash64(F.lit(table), key))  # equal keys only bring pairs to the check
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    members = cut(keyed.join(sizes, "key"))
    light = members.filter(F.col("n") <= PAIRS)
    a, b = F.col("x.fp"), F.col("y.fp")
    pairs = (
        light.alias("x")
        .join(light.alias("y"), (F.col("x.key") == F.col("y.key")) & (a < b))
        .filter(chains(a, b, segments, radius))
        .filter(F.bit_count(a.bitwiseXOR(b)) <= radius)
        .select(a.alias("a"), b.alias("b"))
    )
    crowd = members.filter(F.col("n") > PAIRS).select("fp").distinct()
    points = "array(fp)" if radius < 1 else "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"
    met = crowd.select("fp", F.explode(F.expr(points)).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    # any two that meet are at most 2 bits apart; at most 1 if one of them is the point
    centre = F.array_min("fps") if radius == 2 else F.when(F.array_contains("fps", F.col("point")), F.col("point"))
    stars = met.select(centre.alias("a"), F.explode("fps").alias("b")).filter(F.col("a") != F.col("b"))
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of documents(doc_id, text): the smallest doc_id that links of fingerprints reach.

    Rows of equal fingerprints form one class, so links are sought between distinct fingerprints only. Null, empty and
    blank texts have fingerprint 0; a component of null ids only has a null id; an empty table gives an empty one.
    """
    f = cut(fingerprints(docs, k))
    classes = cut(f.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    label = cut(components(links(classes.select("fp"), radius)))
    linked = classes.join(label, F.col("fp") == F.col("node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    found = cut(linked.join(least, "component").select(F.col("fp").alias("l_fp"), "least"))
    of = cut(classes.join(found, F.col("fp") == F.col("l_fp"), "left").select(F.col("fp").alias("c_fp"), F.coalesce("least", "rep").alias("component_id")))
    return f.join(of, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir) -> DataFrame:
    s = simhash_components(read(spark, sf_dir, "documents"))
    return s.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- near duplicates of texts ---------------------------------------------------------------------------------------

#: Segments of the long fingerprint, each the SimHash of SAMPLED shingles, and how many of them may differ.
RING, SAMPLED, DIFFER = 16, 3, 13
#: Smallest shingle hashes of a text that are kept to prune pairs, and how far below the asked similarity they prune: five
#: standard errors of their estimate. What they leave is decided on the complete sets of hashes.
KEPT, MARGIN = 256, 0.125
#: Texts in a bucket up to which its pairs are listed; in larger ones all are compared with CENTRES of them first, and then
#: with all members that this leaves in other components.
BUCKET, CENTRES = 32, 6
#: Members of a large bucket for each of its salts.
SALTED = 768
#: Hashes that a block's texts are compared on at once, and texts whose similarities are: the bounds of a worker's memory.
HASHES, ROWS = 1024, 64
#: Complete sets that are broadcast to the blocks, at most, within the bytes that any broadcast may have.
BROADCAST_SETS = 200_000
#: Texts whose complete sets are asked for, and rows that stay, named by a broadcast up to this many, so that no text moves.
BROADCAST_ASKED = 400_000
#: Edges between texts whose components the driver finds, at most (some 8 MB); more are joined by rounds of shuffles.
DRIVER_EDGES = 100_000
_rng = np.random.default_rng(SEED)
MIX = _rng.integers(0, 1 << 63, (2, RING * SAMPLED), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def segments(u: np.ndarray) -> np.ndarray:
    """RING values: each the SimHash (the majority of each bit) of SAMPLED shingles, those least in orders of its own."""
    low = np.full(RING * SAMPLED, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(u), 4096):
        low = np.minimum(low, ((u[i : i + 4096, None] ^ MIX[0]) * MIX[1]).min(0))
    a, b, c = (low * np.uint64(0x9E3779B97F4A7C15)).reshape(RING, SAMPLED).T
    return (a & b) | (a & c) | (b & c)


def resemblance(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two texts' shingles from their least hashes (all that lie in both texts' kept ranges)."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    top = min([int(z[-1]) for z in (x, y) if len(z) >= KEPT], default=1 << 32)
    x, y = x[x <= top], y[y <= top]
    both = len(np.intersect1d(x, y))
    return both / max(1, len(np.union1d(x, y)))


def jaccard(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two complete sets of sorted hashes."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def complete(texts: DataFrame, k: int) -> DataFrame:
    """(words, full) of rows (words, text): all different shingle hashes of each text, sorted."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            full = [np.unique(hashes(t.as_py(), k)).astype("<u8").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(full, pa.binary())], names=["words", "full"])

    batches(texts.sparkSession)
    return texts.select("words", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "words string, full binary")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(key, doc_id, words, ring, least) of rows (key, doc_id, text): digest of the lower-case words, segments, least hashes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for t in b.column(2):
                text = t.as_py()
                u = np.unique(hashes(text, k))
                words = hashlib.md5(b" ".join(text.lower().split())).hexdigest()
                out.append((words, segments(u).view(np.int64).tolist(), (u[:KEPT] >> np.uint64(32)).astype("<u4").tobytes()))
            if out:
                w, r, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.string()), pa.array(r, pa.list_(pa.int64())), pa.array(s, pa.binary())], names=["key", "doc_id", "words", "ring", "least"])

    batches(docs.sparkSession)
    return docs.select("key", "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, "key long, doc_id long, words string, ring array<long>, least binary")


def ring_chains(a: Column, b: Column) -> Column:
    """The chain condition of pigeonring on the segments of two long fingerprints, for at most DIFFER that differ: the longest
    chain holds all segments, and where it is within bounds some start has all shorter ones within theirs, so it decides."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, d: n + d) <= DIFFER


def near_duplicates(sk: DataFrame, similarity: float, full_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(words, component) of the texts of sk(words, ring, least), one row a text, that resemble others by `similarity` or more.

    full_of(words) gives (words, full) of the texts asked for: the complete hashes on which pairs are decided.
    """
    keyed = sk.select("words", F.posexplode("ring").alias("at", "value")).select("words", "at", F.xxhash64("at", "value").alias("bucket"))
    sizes = cut(keyed.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    members = cut(keyed.join(sizes, "bucket"))
    light = members.filter(F.col("n") <= BUCKET)
    pairs = light.alias("x").join(light.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.words") < F.col("y.words"))).select(F.col("x.words").alias("a"), F.col("y.words").alias("b"))
    heavy = members.filter(F.col("n") > BUCKET)
    weight = cut(heavy.groupBy("words").agg(F.sum("n").alias("weight")))
    by = [F.max(F.struct("weight", "words")).getField("words"), *(F.max(F.struct(F.xxhash64("words", F.lit(i)).alias("h"), "words")).getField("words") for i in range(1, CENTRES))]
    centres = cut(heavy.join(weight, "words").groupBy("bucket").agg(F.array_distinct(F.array(*by)).alias("centres")))
    stars = heavy.join(centres, "bucket").select(F.explode("centres").alias("c"), "words").filter("c <> words").select(F.least("c", "words").alias("a"), F.greatest("c", "words").alias("b"))
    edges = cut(alike(pairs.union(stars).distinct(), sk, similarity, full_of))
    held = cut(divided(heavy, cut(joined(edges))))
    if held.limit(1).count():
        edges = edges.union(cut(blocks(held, similarity, full_of)))
    return joined(edges).select(F.col("node").alias("words"), "component")


def joined(edges: DataFrame) -> DataFrame:
    """components() of edges(a, b) of words: in the driver's memory where there are at most DRIVER_EDGES, for then each round of
    shuffles writes more files than rows."""
    few = edges.limit(DRIVER_EDGES + 1).collect()
    if len(few) > DRIVER_EDGES:
        return components(edges)
    up: dict[str, str] = {}

    def top(x: str) -> str:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in few:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    nodes = list(up)
    found = pa.table({"node": pa.array(nodes, pa.string()), "component": pa.array(map(top, nodes), pa.string())})
    return edges.sparkSession.createDataFrame(found)  # of Arrow: a list would start Python workers of another kind on every executor


def alike(pairs: DataFrame, sk: DataFrame, similarity: float, full_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b) of `similarity` or more: chains and sketches prune, the complete sets decide."""

    @F.pandas_udf("double")
    def estimate(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([resemblance(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    @F.pandas_udf("double")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaccard(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    def both(df: DataFrame, of: DataFrame, c: str) -> DataFrame:
        return df.join(of.select(F.col("words").alias("a"), F.col(c).alias("ca")), "a").join(of.select(F.col("words").alias("b"), F.col(c).alias("cb")), "b")

    near = cut(both(pairs, sk, "ring").filter(ring_chains(F.col("ca"), F.col("cb"))).select("a", "b"))
    near = cut(both(near, sk, "least").filter(estimate("ca", "cb") >= similarity - MARGIN).select("a", "b"))
    asked = near.select(F.col("a").alias("words")).union(near.select(F.col("b").alias("words"))).distinct()
    return both(near, cut(full_of(asked)), "full").filter(exact("ca", "cb") >= similarity).select("a", "b")


def divided(heavy: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, words, label, salts) of the members of heavy buckets that hold two components at least."""
    held = cut(heavy.join(label.select(F.col("node").alias("words"), "component"), "words", "left").select("bucket", "words", F.coalesce("component", "words").alias("label"), F.ceil(F.col("n") / SALTED).alias("salts")))
    mixed = held.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("bucket")
    return held.join(mixed, "bucket", "left_semi")


def blocks(held: DataFrame, similarity: float, full_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs (a, b) of `similarity` or more in different components of held(bucket, words, label, salts), all compared.

    A bucket's members are dealt to its salts, and every two salts make a block of some 2 * SALTED texts with their
    complete sets: no task gathers a bucket, and no table lists its pairs. Blocks are dealt out by their members' digests; the
    sets come to them by a broadcast where they are few, and else move with each block.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = linked([np.frombuffer(f, "<u8") for f in pdf["full"]], pd.factorize(pdf["label"])[0], similarity)
        w = pdf["words"].to_numpy(object)
        return pd.DataFrame({"a": np.minimum(w[i], w[j]), "b": np.maximum(w[i], w[j])}, dtype=object)

    full = cut(full_of(held.select("words").distinct()))
    dealt = held.withColumn("salt", F.expr("pmod(xxhash64(words), salts)")).withColumn("other", F.explode(F.expr("sequence(0L, salts - 1L)")))
    dealt = dealt.select("bucket", F.least("salt", "other").alias("x"), F.greatest("salt", "other").alias("y"), "words", "label")
    sets = broadcast_below(full, BROADCAST_SETS)
    placed = dealt.repartition("bucket", "x", "y") if sets is not full else dealt
    return placed.join(sets, "words").groupBy("bucket", "x", "y").applyInPandas(one, "a string, b string").distinct()


def linked(sets: list[np.ndarray], label: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of sets in different components with a Jaccard similarity of `similarity` or more."""
    n = np.array([len(s) for s in sets])
    both = np.zeros((len(sets), len(sets)), np.float32 if n.max(initial=0) < 1 << 24 else np.float64)  # either counts exactly
    if len(n) and label.min() < label.max():
        _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[value] > 1
        owner, value = np.repeat(np.arange(len(n)), n)[shared], (np.cumsum(count > 1) - 1)[value[shared]]
        order = np.argsort(value, kind="stable")
        owner, value = owner[order], value[order]
        m, more = np.empty((len(n), HASHES), np.float32), np.empty((len(n), len(n)), np.float32)
        for at in range(0, int(value[-1]) + 1 if len(value) else 0, HASHES):
            lo, hi = np.searchsorted(value, (at, at + HASHES))
            m.fill(0)
            m[owner[lo:hi], value[lo:hi] - at] = 1
            both += np.matmul(m, m.T, out=more)
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(n), ROWS):
        b = both[at : at + ROWS].astype(np.float64)
        like = b / np.maximum(1, n[at : at + ROWS, None] + n[None] - b)
        i, j = np.nonzero((like >= similarity) & (label[at : at + ROWS, None] != label[None]))
        found.append(np.stack([i + at, j])[:, i + at < j])
    i, j = np.concatenate(found, axis=1)
    return i, j


def near_dedup(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of documents(doc_id, text, ...), one of each group of near duplicates: that of the smallest doc_id, null last.

    Texts of equal words (A-Z in either case, any white space) are one group; groups whose k-word shingles have a Jaccard
    similarity of `similarity` or more are joined. A 64-bit SimHash of whole texts cannot find those (at 0.8 a median of 10
    bits differ), so the fingerprint is a ring of 16 segments, each the SimHash of three sampled shingles: similar texts
    have equal segments, which give the candidates; pigeonring chains and the least shingle hashes prune them; the complete
    sets of shingle hashes decide. In buckets of over BUCKET texts all are compared with CENTRES of them, the best connected
    one first, and then with all that are still in other components. Null, empty and blank texts are one group; of rows equal in id and text one stays; an empty table gives
    an empty one.
    """
    rows = docs.select(F.struct(*docs.columns).alias("d")).withColumn("key", F.xxhash64("d.doc_id", "d.text"))
    own_id = F.col("d.doc_id").cast("long")
    s = cut(sketches(rows.select("key", F.col("d.doc_id").cast("long").alias("doc_id"), F.col("d.text").alias("text")), k))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")).alias("first")
    texts = cut(s.groupBy("words").agg(first, F.first("ring").alias("ring"), F.first("least").alias("least"), F.count("*").alias("n")))

    def full_of(words: DataFrame) -> DataFrame:
        asked = texts.join(words, "words", "left_semi").select("words", F.col("first.key").alias("t_key"), F.col("first.doc_id").alias("t_id"))
        found = rows.join(broadcast_below(asked, BROADCAST_ASKED), (F.col("key") == F.col("t_key")) & own_id.eqNullSafe(F.col("t_id"))).select("words", F.col("d.text").alias("text"))
        return complete(found, k).dropDuplicates(["words"])

    groups = near_duplicates(texts, similarity, full_of)
    g = texts.select("words", "first").join(groups.withColumnRenamed("words", "g_words"), F.col("words") == F.col("g_words"), "left")
    kept = cut(g.groupBy(F.coalesce("component", "words").alias("component")).agg(F.min("first").alias("first")).select(F.col("first.key").alias("kept"), F.col("first.doc_id").alias("k_id")))
    out = rows.join(broadcast_below(kept, BROADCAST_ASKED), (F.col("key") == F.col("kept")) & own_id.eqNullSafe(F.col("k_id")), "left_semi")  # by id too: a hash alone could name two rows
    if s.groupBy("key", "doc_id").count().filter("count > 1").limit(1).count():
        out = out.withColumn("own", own_id).dropDuplicates(["key", "own"])
    return out.select("d.*")
