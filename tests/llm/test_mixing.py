import re
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sylva.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def filled(sizes, weights, epochs):
    """Water-filling one clamp at a time."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, open_, target = sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: budget * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > epochs * sizes[s] + 1e-9}
        if not over:
            return target | share
        for s in over:
            target[s] = epochs * sizes[s]
            budget -= target[s]
        open_ -= over
    return target


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from(["a", "b", "é", "B", ""])), st.integers(0, 900), min_size=1))
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), 3).collect()}
    want = filled(sizes, (5, 2, 1), 3)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(want[s], abs=1e-6) and got[s] <= 3 * sizes[s] + 1e-9


def test_mix(spark, odd, clashing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    sizes, taken, targets, largest = Counter(), Counter(), {}, defaultdict(int)
    for r in rows:
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.copies <= 3
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
        targets[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s]
    again = mixing.mix(clashing.repartition(3))
    key = lambda r: (str(r.doc_id), str(r.text), r.copies, r.size)
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))


def test_equal_rows(spark):
    """Of 1,000 rows equal in id and text as many are taken as fit, also where they differ in other columns."""
    rows = [(1, "w " * 12, "a", i % 3) for i in range(1000)] + [(2 + i, "v " * (10 + i % 7), "b", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other long")
    size = {s: sum(12 if r[0] == 1 else 10 + (r[0] - 2) % 7 for r in rows if r[2] == s) for s in "ab"}
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    want = filled(size, (5, 2, 1), 3)
    for s in "ab":
        taken = sum(r.size * r.copies for r in got if r.source == s)
        assert want[s] - 16 < taken <= want[s] and all(0 <= r.copies <= 3 for r in got)
    assert mixing.mixed_rows(docs).count() == sum(r.copies for r in got)
    again = mixing.mixed_rows(docs.repartition(5)).groupBy("doc_id", "other").count().collect()
    assert sorted(again) == sorted(mixing.mixed_rows(docs).groupBy("doc_id", "other").count().collect())


def test_rows(odd, clashing, empty):
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r.doc_id] += r.copies
    got = mixing.mixed_rows(clashing)
    assert got.columns == clashing.columns
    assert Counter(r.doc_id for r in got.collect()) == +want
    assert mixing.mix(empty).count() == mixing.mixed_rows(empty).count() == 0
