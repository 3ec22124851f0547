import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sylva.operators import cover, filters, graph, spatial, treesets


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"tree_id": np.repeat([1, 2], 400), "point_id": np.tile(np.arange(400), 2)})
    p[["x", "y", "z"]] = rng.random((800, 3)) * [1, 1, 2]
    return p, spark.createDataFrame(p)


def serial(p, reach, ball, nmin, prio):
    """Centres by one pass over the points in their order."""
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    open_, out = np.ones(len(p), bool), []
    for i in np.argsort(prio):
        if open_[i] and (d[i] < ball[i] ** 2).sum() >= nmin:
            out.append(i)
            open_ &= ~(d[i] < reach[i] ** 2)
    return out


def order(ids, classes=None):
    keys = [hashlib.md5(f"1:{i}".encode()).hexdigest() for i in ids]
    return np.array([f"{0 if classes is None else classes[k]}{h}" for k, h in enumerate(keys)])


@pytest.mark.parametrize("nmin", [1, 4])
def test_uniform_cover_is_the_serial_one(cloud, nmin):
    p, df = cloud
    c, m, e = cover.cover(df, 0.25, 0.3, nmin)
    got = c.toPandas()
    for t, g in p.groupby("tree_id"):
        xyz = g[["x", "y", "z"]].to_numpy()
        want = serial(xyz, np.full(400, 0.25), np.full(400, 0.3), nmin, order(g["point_id"]))
        assert sorted(want) == sorted(got[got.tree_id == t].set_id)
        own = m.filter(F.col("tree_id") == t).toPandas()
        d = np.sqrt(((xyz[:, None] - xyz[want][None]) ** 2).sum(-1))
        near = {i: want[int(d[i].argmin())] for i in range(400) if d[i].min() < 0.3}
        assert near == dict(zip(own.point_id, own.set_id, strict=True))  # a partition of what balls hold
        links = {tuple(r) for r in e.filter(F.col("tree_id") == t).select("src", "dst").toPandas().to_numpy()}
        assert links == {(b, a) for a, b in links} and links
        one = {(want[k], near[i]) for i in near for k in range(len(want)) if d[i, k] < 0.3 and want[k] != near[i]}
        assert links == one | {(b, a) for a, b in one}


def test_variable_cover_is_the_serial_one(cloud):
    p, df = cloud
    rs = (p["point_id"] * 7) % 257
    got = cover.centres(df, 0.3, 0.4, 1, relative=df.withColumn("rs", (F.col("point_id") * 7 % 257).cast("int")), smallest=0.1).toPandas()
    for t, g in p.groupby("tree_id"):
        r = rs[g.index].to_numpy()
        share = r / 256 * (1 - 0.1 / 0.3) + 0.1 / 0.3
        reach = 0.3 * share
        ball = reach + np.sqrt(share) * 0.1
        use = r > 0
        xyz, ids = g[["x", "y", "z"]].to_numpy()[use], g["point_id"].to_numpy()[use]
        classes = np.where(r <= 32, 0, np.where(r <= 128, 1, 2))[use]
        want = serial(xyz, reach[use], ball[use], 1, order(ids, classes))
        assert sorted(ids[want]) == sorted(got[got.tree_id == t].set_id)


def test_kth_distance(cloud):
    p, df = cloud
    got = spatial.kth_distance(df, 7, 0.05).toPandas().set_index(["tree_id", "point_id"]).distance
    for t, g in p.groupby("tree_id"):
        xyz = g[["x", "y", "z"]].to_numpy()
        d = np.sort(np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)), axis=1)[:, 6]
        assert np.allclose(got.loc[t].sort_index(), d)


def test_kth_distance_of_few_points(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 5.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0)], "tree_id long, point_id long, x double, y double, z double")
    got = {(r.tree_id, r.point_id): r.distance for r in spatial.kth_distance(df, 2, 0.1).collect()}
    assert got == {(1, 1): 5.0, (1, 2): 5.0, (2, 1): None}
    assert spatial.kth_distance(df.filter("tree_id = 9"), 2, 0.1).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    for n, m in ((60, 40), (200, 190), (50, 0)):
        edges = rng.integers(0, n, (m, 2))
        label = np.arange(n)
        for _ in range(n):
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(pd.DataFrame(edges, columns=["a", "b"]).astype("int64"), "a long, b long")).collect()}
        assert all(got.get(i, i) == label[i] for i in range(n))
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in graph.components(path).collect()} == {0}
    hub = spark.range(1, 5000).select(F.lit(7777).cast("long").alias("a"), "id").toDF("a", "b")
    assert {r.component for r in graph.components(hub).collect()} == {1}


def test_small_components(spark):
    rng = np.random.default_rng(3)
    big, small = rng.random((400, 3)), rng.random((10, 3)) * 0.02 + 5
    p = np.vstack([big, small])
    df = spark.createDataFrame(pd.DataFrame({"tree_id": 1, "point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    assert {r.point_id for r in cover.small_components(df, 0.3, 0.4, 2).collect()} == set(range(400))


def test_filters_on_nan_and_single_points(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, nan, 0.0, 0.0), (1, 3, None, 0.0, 0.0), (1, 4, 0.0, 0.0, 0.5)], "tree_id long, point_id long, x double, y double, z double")
    assert {r.point_id for r in filters.valid_points(df).collect()} == {1, 4}
    one = filters.density_outliers(filters.valid_points(df), 0.01).collect()
    assert all(not r.keep for r in one)  # equal counts lie on, not over, their mean
    assert filters.voxel_downsample(df.filter("tree_id = 2"), 0.1).count() == 0


def test_base_shrinks(spark):
    wide = [(1, 100 + i, float(x), float(y), 0.05) for i, (x, y) in enumerate([(0, 0), (5, 0), (0, 5), (5, 5)])]
    stem = [(1, i, 2.0, 2.0, i * 0.5) for i in range(60)]
    df = spark.createDataFrame(wide + stem, "tree_id long, set_id long, x double, y double, z double")
    got = {r.set_id for r in treesets.base_sets(df).collect()}
    assert 0 in got


def test_stray_points(spark):
    """A point far off costs a few more rounds; its k-th distance and the closest pairs are those of brute force."""
    import time

    rng = np.random.default_rng(4)
    cube = rng.random((400, 3))
    took = {}
    for far in (2.0, 1000.0):
        p = np.vstack([cube, [[far, 0.5, 0.5], [far, 0.6, 0.5], [-far, 0, 0]]])
        df = spark.createDataFrame(pd.DataFrame({"tree_id": 1, "point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
        began = time.time()
        got = {r.point_id: r.distance for r in spatial.kth_distance(df, 5, 0.1).collect()}
        took[far] = time.time() - began
        d = np.sort(np.linalg.norm(p[:, None] - p[None], axis=2), axis=1)[:, 4]
        assert len(got) == len(p) and all(abs(got[i] - d[i]) < 1e-9 for i in range(len(p)))
        ids = df.withColumnRenamed("point_id", "id")
        for a, b in ((ids.filter("id < 200"), ids.filter("id >= 200")), (ids.filter("id = 400"), ids.filter("id = 402")), (ids.filter("id < 5"), ids.filter("id > 399"))):
            i, j = (np.array([r.id for r in x.collect()]) for x in (a, b))
            m = np.linalg.norm(p[i][:, None] - p[j][None], axis=2)
            (one,) = spatial.nearest_pair(a, b, ["tree_id"]).collect()
            assert abs(one.distance - m.min()) < 1e-9 and abs(m[list(i).index(one.a_id), list(j).index(one.b_id)] - m.min()) < 1e-9
    assert took[1000.0] < 5 * took[2.0] + 20
    few = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0), (2, 2, 0.0, 0.0, 0.0)], "tree_id long, point_id long, x double, y double, z double")
    assert sorted((r.tree_id, r.distance) for r in spatial.kth_distance(few, 2, 0.1).collect()) == [(1, None), (2, 0.0), (2, 0.0)]


def test_main_segments(spark):
    up = {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 1, 7: 6}
    df = spark.createDataFrame([(1, s, p) for s, p in up.items() for _ in range(2)], "tree_id long, seg_id long, parent_seg long")
    assert sorted(r.seg_id for r in treesets.main_segments(df).collect()) == [1, 2, 3, 4, 6, 7]


@pytest.fixture(scope="module")
def two_trees(spark):
    """Points of two trees, one far point and one repeated point among them."""
    rng = np.random.default_rng(5)
    xyz = np.vstack([rng.uniform(0, 1, (300, 3)), [[2.0, -1.0, 3.0], [0.5, 0.5, 0.5], [0.5, 0.5, 0.5]]])
    return spark.createDataFrame(pd.DataFrame({"tree_id": np.arange(303) % 2, "point_id": np.arange(303), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))


def moved(df) -> list[str]:
    """The exchanges of a plan that is not run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line]


def test_points_move_once(spark):
    """Density, counts and distances of the fixture's points need one exchange, of the columns read."""
    from __spark_entry__ import queries

    for name in ("b2_knn_outlier", "b3_density_outlier", "c2_radius_join", "c3_variable_stencil", "c7_kth_distance"):
        found = moved(queries()[name](spark, "/root/testdata/sf0.001"))
        assert len(found) == 1 and "l_suppkey" in found[0], (name, found)


def test_far_points_in_arrays():
    """Cells of points however far off don't overflow, and no pair is listed twice."""
    from sylva.functions import neighbours

    rng = np.random.default_rng(6)
    xyz = np.vstack([rng.uniform(0, 1, (200, 3)), [[1e15, -1e15, 3.0], [-4e9, 0, 0]]])
    tree = np.arange(202) // 90
    n, ids = neighbours.counts(tree, xyz, 0.09, 0.3, np.arange(202))
    d = ((xyz[:, None] - xyz[None]) ** 2).sum(2)
    near = (d < 0.09) & (tree[:, None] == tree[None])
    assert (n == near.sum(1)).all() and (ids == (near * np.arange(202)).sum(1)).all()
    d[tree[:, None] != tree[None]] = np.inf
    assert np.allclose(neighbours.kth(tree, xyz, 4, 0.1), np.sqrt(np.sort(d, 1)[:, 3]), rtol=1e-9)


def test_arrays_and_joins_agree(spark, two_trees, monkeypatch):
    """Trees that a task can hold in arrays give the rows that joins of cells give."""
    from sylva.operators import filters

    def every(df):
        return [sorted(map(tuple, d.collect()), key=str) for d in (filters.density_outliers(df, 0.04), filters.knn_outliers(df, 4, 1.0), spatial.kth_distance(df, 5, 0.1), spatial.count_near(df, "0.01 + 0.01 * (point_id % 3)", 0.2))]

    arrays = every(two_trees)
    for most in (0, 151):  # no tree in arrays, one of two
        monkeypatch.setattr(spatial, "TREE_POINTS", most)
        for a, b in zip(arrays, every(two_trees), strict=True):
            assert len(a) == len(b)
            for x, y in zip(a, b, strict=True):
                assert x == pytest.approx(y)


def test_covers_move_points_once(spark):
    from __spark_entry__ import queries

    for name in ("b4_small_components", "d1_cover_centres", "d2_cover_variable"):
        found = moved(queries()[name](spark, "/root/testdata/sf0.001"))
        assert len(found) == 1 and "l_suppkey" in found[0], (name, found)


def test_rounds_with_and_without_lists(monkeypatch):
    """Centres in arrays are those of the serial pass, also where sizes differ and pairs are too many to hold."""
    from sylva.functions import neighbours

    rng = np.random.default_rng(8)
    n = 400
    xyz, rank, reach = rng.uniform(0, 1, (n, 3)), rng.permutation(n), rng.uniform(0.1, 0.3, n)
    tree, want = np.arange(n) // 250, []
    for i in np.argsort(rank):
        if not any(tree[c] == tree[i] and ((xyz[c] - xyz[i]) ** 2).sum() < reach[c] ** 2 for c in want):
            want.append(i)
    for listed in (neighbours.LISTED, 10):
        monkeypatch.setattr(neighbours, "LISTED", listed)
        assert neighbours.first_independent(tree, xyz, rank, reach, reach * 1.1, 1).tolist() == sorted(want)


def test_cylinders_go_to_cells_where_their_tree_lies(spark):
    """No exchange moves cylinders that are copied to cells already."""
    from __spark_entry__ import queries

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = moved(queries()["n2_nearest_cylinder"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set(key, before)
    assert any("tree_id" in line for line in found) and not any("cx" in line for line in found), found


def test_starts_are_found_where_trees_lie(spark, monkeypatch):
    """Starts found again in arrays are those that joins of cells give, of all cylinders, and points move once."""
    from sylva.operators import kernels, spatial
    from sylva.sources.fixtures import load

    from __spark_entry__ import queries

    points, c = load(spark, "/root/testdata/sf0.001", "points"), load(spark, "/root/testdata/sf0.001", "cylinders")
    c = c.withColumn("old_radius", F.when(F.col("position") < 4, F.col("radius") * 0.8)).cache()
    columns = ["tree_id", "cyl_id", "start_x", "start_y", "start_z"]
    got = kernels.recentred(points, c).select(columns).toPandas().sort_values(columns[:2], ignore_index=True)
    monkeypatch.setattr(spatial, "TREE_POINTS", 0)
    want = kernels.recentred(points, c).select(columns).toPandas().sort_values(columns[:2], ignore_index=True)
    at = c.select(columns).toPandas().sort_values(columns[:2], ignore_index=True)
    assert len(got) == len(at) and (got[columns[:2]] == want[columns[:2]]).all(axis=None)
    assert np.allclose(got[columns[2:]], want[columns[2:]], atol=1e-9) and 0 < (np.abs(got[columns[2:]] - at[columns[2:]]) > 1e-6).any(axis=1).sum() < len(at)
    monkeypatch.undo()
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = moved(queries()["h7_recentred_starts"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set(key, before)
    assert sum("l_partkey" in line for line in found) <= 3 and not any("cx" in line or "point_id" in line for line in found), found
