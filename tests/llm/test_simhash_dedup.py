import random
import tracemalloc

import numpy as np
import xxhash

from sylva.llm import simhash_dedup as m


def naive(text, k):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    g = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(values, radius):
    """Components by comparing all pairs."""
    values, label = sorted(values), {}
    for v in values:
        if v in label:
            continue
        stack = [v]
        label[v] = v
        while stack:
            a = stack.pop()
            for b in values:
                if b not in label and (a ^ b).bit_count() <= radius:
                    label[b] = v
                    stack.append(b)
    return label


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_fingerprints(odd):
    rows = m.fingerprints(odd).collect()
    texts = odd.collect()
    for r, t in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.fp)), sorted(texts, key=lambda r: (r.doc_id is None, r.doc_id, signed(naive(r.text, 3)))), strict=True):
        assert r.fp == signed(naive(t.text, 3))


def crowd(rng, n, centres, flips):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(n):
            v = c
            for b in rng.sample(range(64), rng.randrange(flips + 1)):
                v ^= 1 << b
            out.add(v)
    return out


def test_links_by_brute_force(spark):
    rng = random.Random(2)
    for limit in (m.PAIRS, 1):  # 1: all through the points one bit away
        values = crowd(rng, 40, 12, 4) | crowd(rng, 400, 1, 3) | {rng.getrandbits(64) for _ in range(300)}
        old, m.PAIRS = m.PAIRS, limit
        try:
            for radius in (0, 1, 2):
                edges = m.links(spark.createDataFrame([(signed(v),) for v in values], "fp long"), radius)
                got = {r.node: r.component for r in m.components(edges).collect()}
                want = reach(values, radius)
                groups = {}
                for v in values:
                    groups.setdefault(got.get(signed(v), signed(v)), set()).add(want[v])
                assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))
        finally:
            m.PAIRS = old


def test_chains_lose_nothing(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = []
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for x in rng.sample(range(64), rng.randrange(3)):
            b ^= 1 << x
        rows.append((signed(a), signed(b)))
    df = spark.createDataFrame(rows, "a long, b long")
    assert df.filter(~m.chains(F.col("a"), F.col("b"), 5, 2)).count() == 0


def test_components(odd, clashing, empty):
    texts = {}
    for r in odd.collect():
        texts.setdefault(naive(r.text, 3), []).append(r.doc_id)
    label = reach(texts, 2)
    least = {}
    for v, ids in texts.items():
        least[label[v]] = min([x for x in [*ids, least.get(label[v])] if x is not None], default=None)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(((i, signed(v), least[label[v]]) for v, ids in texts.items() for i in ids), key=key)
    for df in (odd, clashing):
        assert sorted(((r.doc_id, r.fp, r.component_id) for r in m.simhash_components(df).collect()), key=key) == want
    assert m.simhash_components(empty).count() == 0


def near(rng, words, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(len(out) * share)):
        out[i] = f"y{rng.randrange(10**6)}"
    return out


def jaccard(a, b, k=5):
    s = lambda t: {tuple(t[i : i + k]) for i in range(max(1, len(t) - k + 1))}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_near_dedup(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.choice((40, 300, 1200)))] for _ in range(60)]
    rows, group = [], {}
    for g, w in enumerate(base):
        for k in range(rng.choice((1, 2, 5))):
            t = w if k == 0 else near(rng, w, 0.012)
            if jaccard(w, t) >= 0.88:
                group[len(rows)] = g
                rows.append((len(rows), " ".join(t), "en"))
        far = near(rng, w, 0.2)
        group[len(rows)] = -len(rows) - 1
        rows.append((len(rows), " ".join(far), "en"))
    kept = [r.doc_id for r in m.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()]
    first = {}
    for i, g in group.items():
        first.setdefault(g, i)
    assert sorted(kept) == sorted(first.values())


def test_near_dedup_of_a_crowd(spark):
    rng = random.Random(5)
    w = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = [(i, " ".join(near(rng, w, 0.012) if i else w)) for i in range(300)] + [(1000 + i, " ".join(f"z{rng.randrange(9999)}" for _ in range(50))) for i in range(20)]
    kept = {r.doc_id for r in m.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, *range(1000, 1020)}


def test_near_dedup_odd(odd, clashing, empty):
    got = m.near_dedup(clashing)
    assert got.columns == clashing.columns
    ids = [r.doc_id for r in got.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 5, 6} <= set(ids) and not {2, 3, 7, None} & set(ids)
    assert m.near_dedup(empty).count() == 0


def test_resemblance():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b = (np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint32)) for n in (200, 150))
    c = np.unique(np.concatenate([a[:100], b]))
    pack = lambda x: np.sort(x)[: m.KEPT].astype("<u4").tobytes()
    assert m.resemblance(pack(a), pack(a)) == 1 and m.resemblance(pack(a), pack(b)) == 0
    assert m.resemblance(pack(a), pack(c)) == len(np.intersect1d(a, c)) / len(np.union1d(a, c))
    assert m.resemblance(b"", b"") == 0


def split(rng, words, spots):
    """words with those at the spots changed."""
    out = list(words)
    for i in spots:
        out[i] = f"y{rng.randrange(10**9)}"
    return out


def test_near_dedup_decides_on_complete_sets(spark):
    """Long texts just above and just below 0.8, beyond what a sketch of KEPT hashes can tell apart."""
    rng = random.Random(6)
    rows, want = [], set()
    for g in range(24):
        w = [f"w{g}x{i}" for i in range(1504)]  # 1500 shingles; each far spot takes 5 of them
        n = 32 if g % 2 else 35
        t = split(rng, w, range(10, 10 + 40 * n, 40))
        assert (jaccard(w, t) >= 0.8) == bool(g % 2) and abs(jaccard(w, t) - 0.8) < 0.011
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(t))]
        want |= {2 * g} if g % 2 else {2 * g, 2 * g + 1}
    kept = {r.doc_id for r in m.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept - want == set() and want - kept == set()


def test_near_dedup_links_members_of_crowds(spark):
    """Copies of one text too far from each other, each with a twin: the twins' buckets are large and few share a centre."""
    rng = random.Random(7)
    w = [f"w{i}" for i in range(404)]
    rows = []
    for i in range(150):
        t = split(rng, w, rng.sample(range(404), 12))
        twin = split(rng, t, [rng.randrange(404)])
        rows += [(2 * i, t), (2 * i + 1, twin)]
    ids = [i for i, _ in rows]
    sets = [{tuple(t[k : k + 5]) for k in range(400)} for _, t in rows]
    least = {i: i for i in ids}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    want = {root(i) for i in ids}
    assert len(want) > 100
    kept = {r.doc_id for r in m.near_dedup(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()}
    assert kept == want


def test_few_edges_need_no_rounds_of_shuffles(spark, monkeypatch):
    """Components of few edges are found without a shuffle; beyond the bound they are the same."""
    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(170)] + [("n0", "n0")]
    edges = spark.createDataFrame(pairs, "a string, b string")
    want = {tuple(r) for r in m.components(edges).collect()}
    with monkeypatch.context() as p:
        p.setattr(m, "DRIVER_EDGES", len(pairs) - 1)
        assert {tuple(r) for r in m.joined(edges).collect()} >= want
    monkeypatch.setattr(m, "components", None)
    got = {tuple(r) for r in m.joined(edges).collect()}
    assert want <= got and all(a == b for a, b in got - want)  # a node of no other may be there, as its own
    assert m.joined(edges.filter("false")).count() == 0
    rows = [(i, f"{'a b c d e f g h i j k l ' * 3} x{i % 2}") for i in range(6)]
    assert [r.doc_id for r in m.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_blocks_take_little_memory():
    """The largest block, 2 * SALTED texts, some alike: the pairs of all are right, and no more is held than a worker has."""
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, 300, np.uint64)
    sets = [np.unique(np.where(rng.random(300) < 0.1 * (i % 3), rng.integers(0, 1 << 62, 300, np.uint64), base)) for i in range(2 * m.SALTED)]
    label = np.arange(len(sets)) // 2
    tracemalloc.start()
    i, j = m.linked(sets, label, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(got) == len(i)
    for a, b in rng.integers(0, len(sets), (5000, 2)).tolist():
        want = a < b and label[a] != label[b] and m.jaccard(sets[a].tobytes(), sets[b].tobytes()) >= 0.8
        assert want == ((a, b) in got)
    i, j = m.linked([], np.zeros(0, int), 0.8)
    assert len(i) == len(j) == 0


def test_few_edges_start_no_python_workers(spark):
    """Components found in the driver come as Arrow: a list of rows is unpickled by workers that no other step uses."""
    edges = spark.createDataFrame([("a", "b"), ("c", "b")], "a string, b string")
    assert "PythonRDD" not in m.joined(edges)._jdf.queryExecution().toRdd().toDebugString()
