import hashlib
import random

import xxhash

from sylva.llm import fingerprints as m


def successors(rows):
    """(row, next row) by descending id, nulls last, ties by falling hash of the text; the last one's is the first."""
    hashed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)  # noqa: E731  as signed
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -hashed(r[1]), r[1]))
    return list(zip(order, order[1:] + order[:1], strict=True))


def edited(text, follow):
    h = len(text) // 2
    return text[: len(text) - h] + follow[:h]


def check(df):
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    want = sorted((str(a[0]), len(a[1]), hashlib.sha256(edited(a[1], b[1]).encode()).hexdigest()) for a, b in successors(rows))
    got = m.with_edits(df).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    return got, rows


def test_edits(spark, odd, clashing, empty):
    got, rows = check(odd.select("doc_id", "text"))
    check(clashing)
    assert m.with_edits(empty).count() == 0
    check(spark.createDataFrame([(7, "only one row")], "doc_id long, text string"))
    check(spark.createDataFrame([(3, f"t{i} same id") for i in range(20)], "doc_id long, text string"))
    check(spark.createDataFrame([(None, f"t{i}") for i in range(9)] + [(i, f"u{i}" * i) for i in range(200)], "doc_id long, text string"))


def test_one_id_of_most_rows(spark):
    """An id, and null, that fill several ranges are parted by the hash of the text."""
    rows = [(None, f"n{i} x") for i in range(300)] + [(5, f"f{i} y") for i in range(300)] + [(i, f"u{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df)
    r = m.ranges(df).filter("not ghost").groupBy("doc_id").agg({"part": "approx_count_distinct"}).collect()
    parts = {x[0]: x[1] for x in r}
    assert parts[None] > 3 and parts[5] > 3


def test_next_fingerprint(odd):
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    got = m.with_edits(odd).collect()
    fp = {}
    for r in got:
        fp.setdefault((r.doc_id, r.n_chars), set()).add(r.fp)
    assert all(len(x) == 1 for x in fp.values())
    want = sorted((str(a[0]), *sorted(fp[a[0], len(a[1])]), *sorted(fp[b[0], len(b[1])])) for a, b in successors(rows))
    assert sorted((str(r.doc_id), r.fp, r.next_fp) for r in got) == want


def test_votes(spark):
    """Against adding up the votes of each bit of Spark's own hashes."""
    from pyspark.sql import functions as F

    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(n)) for n in (0, 1, 2, 126, 127, 128, 255, 1000)]
    d = spark.createDataFrame(list(enumerate(texts)), "k long, text string").withColumn("w", m.words(F.col("text"))).withColumn("ts", m.terms("w"))
    fps = {r.k: r.fp for r in m.simhash(d.select("k", "ts"), ["k"], "ts").collect()}
    for r in d.collect():
        votes = sum(1 << b for b in range(64) if sum(1 if (t >> b) & 1 else -1 for t in r.ts) > 0)
        assert fps[r.k] & (1 << 64) - 1 == votes
    assert fps[0] == 0


def test_near_by_brute_force(spark):
    rng = random.Random(2)
    values = set()
    for _ in range(60):
        c = rng.getrandbits(64)
        for _ in range(6):
            v = c
            for b in rng.sample(range(64), rng.randrange(6)):
                v ^= 1 << b
            values.add(v - (1 << 64) if v >> 63 else v)
    df = spark.createDataFrame([(v,) for v in values for _ in range(2)], "fp long")
    u = sorted(values)
    dist = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    for radius, blocks in ((3, 6), (2, 4), (0, 1)):
        want = {(a, b) for i, a in enumerate(u) for b in u[i + 1 :] if dist(a, b) <= radius}
        assert {(r.a, r.b) for r in m.near(df, radius, blocks).collect()} == want
        asked = u[::7]
        want = {(a, b) for a in asked for b in u if a != b and dist(a, b) <= radius}
        assert {(r.a, r.b) for r in m.near(df, radius, blocks, spark.createDataFrame([(a,) for a in asked], "fp long")).collect()} == want


def test_query(spark, sf):
    rows = m.op5_fingerprints(spark, sf).collect()
    fps = {int(r.fingerprint, 16) for r in rows}
    for r in rows:
        own = int(r.fingerprint, 16)
        assert r.n_same == (sum(x.fingerprint == r.fingerprint for x in rows) - 1 if r.doc_id % 100 == 0 else None)
        assert r.n_near == (sum(0 < (own ^ f).bit_count() <= 3 for f in fps) if r.doc_id % 100 == 0 else None)
        assert abs(r.near_edited - (1 - (own ^ int(r.edited_fingerprint, 16)).bit_count() / 64)) < 1e-9
