import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sylva.operators import attributes, branches, cylinders, optimum, simplify
from sylva.plans import reconstruct
from sylva.sources import clouds, params
from sylva.sources.fixtures import load
from sylva.streaming import ingest

from .conftest import SF


def limb(rng, start, axis, length, r0, r1, n):
    a = np.array(axis, float) / np.linalg.norm(axis)
    u = np.cross(a, [1, 0, 0.3])
    u /= np.linalg.norm(u)
    v, h, t = np.cross(a, u), rng.uniform(0, length, n), rng.uniform(0, 2 * np.pi, n)
    r = r0 + (r1 - r0) * h / length
    return np.array(start) + h[:, None] * a + r[:, None] * (np.cos(t)[:, None] * u + np.sin(t)[:, None] * v) + rng.normal(0, 0.002, (n, 3))


@pytest.fixture(scope="module")
def y_tree(spark):
    rng = np.random.default_rng(3)
    p = np.vstack([limb(rng, [0, 0, 0], [0, 0, 1], 6, 0.15, 0.06, 9000), limb(rng, [0.1, 0, 3], [1, 0, 1], 2, 0.05, 0.03, 2500), limb(rng, [-0.1, 0, 4], [-1, 0.2, 1], 1.5, 0.04, 0.02, 2000)])
    return spark.createDataFrame(pd.DataFrame({"tree_id": 1, "point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})).cache()


ONE = params.Params(patch_diam1=(0.12,), ball_rad1=(0.135,), patch_diam2_max=(0.1,), ball_rad2=(0.11,), patch_diam2_min=(0.04,))


def test_reconstruction(y_tree):
    (_, c), = reconstruct.reconstruct(y_tree, ONE)
    t = {k: v.toPandas() for k, v in reconstruct.model_tables(y_tree, c, tria=True).items()}
    a = t["attributes"].iloc[0]
    truth = 1000 * np.pi / 3 * (6 * (0.15**2 + 0.15 * 0.06 + 0.06**2) + 2 * (0.05**2 + 0.05 * 0.03 + 0.03**2) + 1.5 * (0.04**2 + 0.04 * 0.02 + 0.02**2))
    assert a.total_volume == pytest.approx(truth, rel=0.2) and a.tree_height == pytest.approx(6, abs=0.2) and 2 <= a.number_branches <= 4
    assert a.dbh_qsm == pytest.approx(2 * (0.15 - 0.015 * 1.3), rel=0.1)
    assert t["distance"].iloc[0].all_median < 0.01
    assert a.location_z == pytest.approx(0, abs=0.1) and 0 < a.crown_base_height < 6.1 and a.area_alpha > 0 and 0.2 < a.crown_diam_ave < a.diam_max
    assert len(t["profile"]) == 10 and t["taper"]["diameter"].iloc[0] == pytest.approx(0.3, rel=0.2) and len(t["cylinder_dia"]) and len(t["branch_ang"])
    assert len(t["triangulation"]) > 100 and a.mix_total_volume == pytest.approx(a.total_volume, rel=0.15) and a.dbh_tri == pytest.approx(a.dbh_qsm, rel=0.15)
    assert 1 <= a.tria_trunk_length < 6 and a.tria_trunk_volume < a.mix_trunk_volume
    x = t["cylinder"]
    ids = set(x.cyl_id)
    assert set(x.parent.dropna()) <= ids and set(x.extension.dropna()) <= ids and x.parent.isna().sum() == 1


def test_cloud_with_ground(spark):
    """A stem in a plot with ground and a shrub: the model is that of the stem alone."""
    rng = np.random.default_rng(8)
    stem = limb(rng, [0, 0, 0], [0, 0, 1], 6, 0.15, 0.08, 9000)
    ground = np.column_stack([rng.uniform(-1.6, 1.6, (2500, 2)), rng.normal(0, 0.005, 2500)])
    shrub = np.column_stack([rng.normal(1.4, 0.1, (300, 2)), rng.uniform(0.1, 0.5, 300)])
    p = np.vstack([stem, ground[np.linalg.norm(ground[:, :2], axis=1) > 0.15], shrub])
    df = spark.createDataFrame(pd.DataFrame({"tree_id": 1, "point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    from dataclasses import replace

    (_, c), = reconstruct.reconstruct(df, replace(ONE, only_tree=False))
    t = attributes.totals(c).first()
    truth = 1000 * np.pi / 3 * 6 * (0.15**2 + 0.15 * 0.08 + 0.08**2)
    assert t.total_volume == pytest.approx(truth, rel=0.2) and t.tree_height == pytest.approx(6, abs=0.4)
    assert c.filter("abs(start_x) > 0.6 or abs(start_y) > 0.6").count() == 0


def test_repeats_side_by_side(y_tree):
    """Models of several repeats are those of each seed by itself, and trees keep their ids."""
    two = y_tree.union(y_tree.withColumn("tree_id", F.lit(-3).cast("long")))
    got = reconstruct.make_models(two, ONE, repeats=2, tries=1).cache()
    assert sorted((r.tree_id, r.model) for r in got.select("tree_id", "model").distinct().collect()) == [(-3, 1), (-3, 2), (1, 1), (1, 2)]
    (_, alone), = reconstruct.reconstruct(y_tree, ONE, 2)
    cols = ["cyl_id", "parent", "branch"]
    assert got.filter("tree_id = 1 and model = 2").select(cols).exceptAll(alone.select(cols)).count() == 0
    near = got.filter("tree_id = 1 and model = 2").agg(F.sum("length")).first()[0]
    assert near == pytest.approx(alone.agg(F.sum("length")).first()[0], rel=1e-6)


def test_models_where_points_lie(spark, y_tree, monkeypatch):
    """Models in arrays are those of the tables in every column, also of trees of few or invalid points, without the tables' steps."""
    rng = np.random.default_rng(4)
    bent = np.vstack([limb(rng, [0, 0, 0], [0.3, 0, 1], 3, 0.2, 0.1, 2500), limb(rng, [0.9, 0, 3], [1, 0, 0.2], 1.5, 0.1, 0.02, 900)])
    odd = [(7, 0, 1.0, 2.0, 3.0), (7, 1, 1.0, 2.0, 3.5), (8, 0, float("nan"), 0.0, 0.0), (None, 0, 0.0, 0.0, 0.0), (9, 0, None, 0.0, 0.0)]
    kinds = "tree_id long, point_id long, x double, y double, z double"
    points = y_tree.union(spark.createDataFrame([(2, i, *map(float, p)) for i, p in enumerate(bent)], kinds)).union(spark.createDataFrame(odd, kinds)).cache()
    (_, c), = reconstruct.reconstruct(points, ONE, 2)
    want = c.orderBy("tree_id", "cyl_id").toPandas()
    assert set(want.tree_id) == {1, 2} and want.groupby(["tree_id", "branch"]).size().max() > 4

    def tables(*_):
        raise AssertionError("the tables' steps were taken")

    with monkeypatch.context() as m:
        m.setattr(reconstruct, "first_stage", tables)
        got = reconstruct.make_models(points, ONE, repeats=2, tries=2).filter("model = 2").orderBy("tree_id", "cyl_id").toPandas()
        assert not reconstruct.make_models(points.filter("tree_id = 7"), ONE, repeats=2, tries=2).count()
    pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False, rtol=1e-9, atol=1e-9)
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


def test_models_of_trees_beyond_a_task(spark, monkeypatch):
    """A tree that a task can't hold is modelled by the tables, beside one that it can."""
    from sylva.operators import spatial

    rng = np.random.default_rng(5)
    rows = [(t, i, *map(float, p)) for t, n in ((1, 900), (2, 700)) for i, p in enumerate(limb(rng, [0, 0, 0], [0, 0, 1], 2, 0.2, 0.15, n))]
    points = spark.createDataFrame(rows, "tree_id long, point_id long, x double, y double, z double").cache()
    order = ["tree_id", "cyl_id"]
    want = reconstruct.make_models(points, ONE, repeats=1, tries=1).orderBy(order).toPandas()
    monkeypatch.setattr(spatial, "TREE_POINTS", 800)
    got = reconstruct.make_models(points, ONE, repeats=1, tries=1).orderBy(order).toPandas()
    assert set(got.tree_id) == {1, 2}
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_equal_seeds_give_equal_segments(y_tree):
    a, b, c = (reconstruct.first_stage(df, ONE, seed)[3].orderBy("seg_id", "layer", "set_id").toPandas() for df, seed in ((y_tree.repartition(5), 2), (y_tree, 2), (y_tree, 3)))
    pd.testing.assert_frame_equal(a, b)
    assert set(a.set_id) != set(c.set_id)


def test_sweep(spark):
    p = params.Params()
    assert len(p.sweep()) == params.sweep_table(spark, p).count() == 8
    assert p.suffix() == "_D0.08_DA0.07_DI0.02" and p.sweep()[0].suffix() == ""
    assert params.sequence(1.0, 1) == (1.0,) and np.allclose(params.sequence(1.0, 3), [0.8, 1.0, 1.2])


def test_derived_parameters(y_tree):
    r = params.derive(y_tree).first()
    assert r.height == pytest.approx(6, abs=0.05) and r.stem_radius == pytest.approx(0.145, abs=0.01) and len(r.pd1) == len(r.br1) == 2
    assert all(b > a for a, b in zip(r.pd1, r.br1, strict=True))


def test_containers_and_models(spark, tmp_path, y_tree):
    two = y_tree.limit(50).withColumn("tree_name", F.lit("oak")).union(y_tree.limit(30).withColumn("tree_name", F.lit("ash")))
    clouds.write_container(two, str(tmp_path / "c"))
    got = clouds.read_container(spark, str(tmp_path / "c")).groupBy("tree_name", "tree_id").count().orderBy("tree_id").collect()
    assert [tuple(r) for r in got] == [("ash", 1, 30), ("oak", 2, 50)]
    c = load(spark, SF, "cylinders")
    tables = {"cylinder": c, "branch": branches.full_branch_table(c)}
    clouds.save_models(tables, str(tmp_path / "m"))
    back = clouds.load_models(spark, str(tmp_path / "m"), [*tables])
    for n, t in tables.items():
        assert back[n].select(t.columns).exceptAll(t.withColumn("tree_id", F.col("tree_id").cast("int"))).count() == 0
    text = clouds.text_tables(c, tables["branch"], attributes.totals(c))
    clouds.save_text(text, str(tmp_path / "t"))
    read = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(str(tmp_path / "t/cylinder"))
    assert read.count() == c.count() and read.columns == c.columns
    clouds.save_matrix(optimum.attribute_statistics(load(spark, SF, "runs"), ["tree_id"]), str(tmp_path / "x"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "x")).count() == len(optimum.ATTRIBUTES)
    p = clouds.points_from(spark.createDataFrame([(1.0, 2, 3, "extra")], "a double, b int, c int, d string"), "a", "b", "c")
    assert p.columns == clouds.POINT and p.dtypes[2:] == [("x", "double"), ("y", "double"), ("z", "double")]


def test_metrics(spark):
    assert len(set(optimum.metric_names())) == 91
    table = optimum.scalar_table(load(spark, SF, "runs")).cache()
    a, b = optimum.metric(table, "nonsense"), optimum.metric(table, "all_mean_dis")
    assert a.exceptAll(b).count() == 0
    one = load(spark, SF, "runs").filter("model = 1").dropDuplicates(["tree_id", *optimum.INPUTS])
    stats = optimum.attribute_statistics(one, ["tree_id", *optimum.INPUTS])
    assert stats.filter("std <> 0").count() == 0  # a single run has no spread


def test_simplification(spark):
    c = load(spark, SF, "cylinders")
    s = simplify.simplify(c, 2, 0.02)
    assert s.filter("branch_order > 2").count() == 0 and s.filter("branch = 1").count() == c.filter("branch = 1").count()
    ids = s.groupBy("tree_id").agg(F.max("cyl_id").alias("m"), F.count("*").alias("n")).filter("m <> n").count()
    assert ids == 0
    m = simplify.merge_pairs(c)
    before, after = (t.agg(F.sum(F.col("radius") ** 2 * F.col("length"))).first()[0] for t in (c, m))
    assert after == pytest.approx(before, rel=1e-9) and m.agg(F.sum("members")).first()[0] == c.count()
    again = simplify.merge_pairs(m)
    assert again.count() <= m.count()


def test_growth_volume_of_the_root_is_the_whole_tree(spark):
    c = load(spark, SF, "cylinders")
    g = cylinders.growth_volumes(c).join(c.filter("parent is null").select("tree_id", "cyl_id"), ["tree_id", "cyl_id"])
    t = attributes.totals(c).select("tree_id", (F.col("total_volume") / 1000).alias("v"))
    assert g.join(t, "tree_id").filter(F.abs(F.col("v") - F.col("growth_volume")) > 1e-9).count() == 0


def test_stream(spark, tmp_path, y_tree):
    y_tree.repartition(3).write.parquet(str(tmp_path / "in"))
    s = ingest.first_of_cells(ingest.read_points(spark, str(tmp_path / "in")), 0.1)
    q = ingest.write_points(s, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    cells = y_tree.select(*(F.floor(F.col(c) / 0.1) for c in "xyz")).distinct().count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == cells


def test_trees_are_dealt_to_all_tasks(spark):
    """Kernels over few bytes run in several tasks, not in one that holds all trees."""
    trees = spark.range(1, 41).withColumnRenamed("id", "tree_id")
    segs = trees.select("tree_id", *(F.lit(v).cast("long").alias(n) for n, v in (("seg_id", 1), ("parent_seg", 0), ("parent_layer", 0), ("layer", 1), ("set_id", 1))))
    raw = trees.select("tree_id", F.lit(1).cast("long").alias("seg_id"), F.lit(0).cast("long").alias("k"), *(F.lit(1.0).alias(n.split()[0]) for n in reconstruct.RAW.split(", ")[3:]))
    made = reconstruct.chain(raw, segs)
    assert made.count() == 40 and made.select(F.spark_partition_id()).distinct().count() > 1
    centres = trees.crossJoin(spark.range(3).withColumnRenamed("id", "set_id")).select("tree_id", "set_id", *(F.col("set_id").cast("double").alias(a) for a in "xyz"))
    edges = trees.select("tree_id", F.explode(F.expr("array((0L, 1L), (1L, 2L), (1L, 0L), (2L, 1L))")).alias("e")).select("tree_id", F.col("e.col1").alias("src"), F.col("e.col2").alias("dst"))
    found = reconstruct.segment_trees(centres, edges, centres.filter("set_id = 0").select("tree_id", "set_id"), 1.0, False, True)
    assert found.select("tree_id").distinct().count() == 40 and found.select(F.spark_partition_id()).distinct().count() > 1
