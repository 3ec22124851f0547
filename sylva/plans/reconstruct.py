"""From point clouds to cylinder models.

Points stay in tables: covers are joins over cells. What follows frontiers (trunk, connectivity, segments) runs as one
function per tree over its cover sets, far fewer than its points; cylinders are fitted per segment; the chain of parents
runs per tree again, over cylinders. Corrections, branches, attributes and distances are plain tables.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forest
from ..functions.fitting import Cylinder
from ..functions.stems import hang_all, segment_cylinders
from ..operators import attributes, branches, cover, distributions, kernels, pmdist, treesets
from ..operators import cylinders as corrections
from ..operators.spatial import by_tree, parted
from ..sources.params import Params
from .lineage import cut_plain as cut  # covers of small and large trees are unions of checkpoints

SEGMENT = "tree_id long, seg_id long, parent_seg long, parent_layer long, layer long, set_id long"
RAW = "tree_id long, seg_id long, k long, radius double, length double, start_x double, start_y double, start_z double, axis_x double, axis_y double, axis_z double, surf_cov double, mad double"
CYLINDER = "tree_id long, branch long, position long, cyl_id long, radius double, length double, start_x double, start_y double, start_z double, axis_x double, axis_y double, axis_z double, parent long, extension long, added boolean, branch_order long, surf_cov double, mad double"

#: Points whose trees are covered at once for models.
MODEL_POINTS = 10_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to all of the session's shuffle partitions: a kernel's time goes by trees, not by bytes, and Spark would
    merge partitions of few bytes into one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def segment_trees(centres: DataFrame, edges: DataFrame, base: DataFrame, patch: float, small: bool, children: bool, stem: DataFrame | None = None, ground: DataFrame | None = None) -> DataFrame:
    """SEGMENT rows of each tree: its sets made one component, segmented from the base, corrected.

    stem: (tree_id, set_id, seg_id) of an earlier segmentation's stem and main branches, which are made connected first; ground: (tree_id,
    set_id) of sets that are none of the tree's, in clouds that hold more than a tree.
    """
    c = centres.select("tree_id", "set_id", "x", "y", "z").join(base.withColumn("base", F.lit(True)), ["tree_id", "set_id"], "left")
    none = ground is None
    c = c.withColumn("ground", F.lit(None).cast("boolean")) if none else c.join(ground.distinct().withColumn("ground", F.lit(True)), ["tree_id", "set_id"], "left")
    c = c.join(stem, ["tree_id", "set_id"], "left") if stem is not None else c.withColumn("seg_id", F.lit(0).cast("long"))

    def one(sets: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        sets = sets.sort_values("set_id", ignore_index=True)
        ids, xyz = sets["set_id"].to_numpy(), sets[["x", "y", "z"]].to_numpy()
        if not len(ids):
            return pd.DataFrame({n.split()[0]: pd.Series(dtype="int64") for n in SEGMENT.split(", ")})
        nei = forest.neighbour_lists(len(ids), np.searchsorted(ids, links["src"].to_numpy()), np.searchsorted(ids, links["dst"].to_numpy()))
        start = np.flatnonzero(sets["base"].notna().to_numpy())
        segment = sets["seg_id"].fillna(0).to_numpy().astype(int)
        found = forest.grown(nei, xyz, start, segment, sets["ground"].notna().to_numpy().copy(), patch, none, small, children)
        rows, tree = [], int(sets["tree_id"].iloc[0])
        for s, (layers, parent, at) in enumerate(found):
            rows += [(tree, s + 1, parent + 1, at + 1, k + 1, int(ids[i])) for k, x in enumerate(layers) for i in x]
        return pd.DataFrame(rows, columns=[n.split()[0] for n in SEGMENT.split(", ")])

    links = edges.select(*(F.col(n).alias(n) for n in ("tree_id", "src", "dst"))).toDF("tree_id", "src", "dst")
    return dealt(c.toDF(*c.columns), "tree_id").groupBy("tree_id").cogroup(dealt(links, "tree_id").groupBy("tree_id")).applyInPandas(one, SEGMENT)


def fit_cylinders(points: DataFrame, member: DataFrame, segs: DataFrame, least: int = 20) -> DataFrame:
    """RAW rows: the cylinders of each segment of over one layer, two sets and `least` points."""
    p = points.join(member, ["tree_id", "point_id"]).join(segs.select("tree_id", "seg_id", "layer", "set_id"), ["tree_id", "set_id"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [n.split()[0] for n in RAW.split(", ")]
        pdf = pdf.sort_values(["layer", "point_id"])
        found = segment_cylinders(pdf[["x", "y", "z"]].to_numpy(), pdf["layer"].to_numpy(), pdf["set_id"].to_numpy(), least)
        if not found:
            return pd.DataFrame({n.split()[0]: pd.Series(dtype="int64" if n.endswith("long") else "float64") for n in RAW.split(", ")})
        key = (int(pdf["tree_id"].iloc[0]), int(pdf["seg_id"].iloc[0]))
        return pd.DataFrame([(*key, k, f.radius, f.length, *f.start, *f.axis, f.coverage, f.mad) for k, f in found], columns=names)

    return dealt(p.select("tree_id", "seg_id", "point_id", "set_id", "layer", "x", "y", "z"), "tree_id", "seg_id").groupBy("tree_id", "seg_id").applyInPandas(one, RAW)


def chain(raw: DataFrame, segs: DataFrame) -> DataFrame:
    """CYLINDER rows: segments with cylinders as branches, parents first, each hung on a cylinder of its parent's as hang() says.
    A segment without cylinders passes its children on to its own parent."""
    parents = segs.select("tree_id", "seg_id", "parent_seg").distinct()
    r = raw.join(parents, ["tree_id", "seg_id"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        fits = []
        for seg, g in pdf.sort_values(["seg_id", "k"]).groupby("seg_id", sort=True):
            own = [(int(t.k), Cylinder(t.radius, t.length, np.array([t.start_x, t.start_y, t.start_z]), np.array([t.axis_x, t.axis_y, t.axis_z]), t.mad, t.surf_cov, True, True)) for t in g.itertuples()]
            fits.append((seg, g["parent_seg"].iloc[0], own))
        rows = hang_all(int(pdf["tree_id"].iloc[0]), fits)
        out = pd.DataFrame(rows, columns=[n.split()[0] for n in CYLINDER.split(", ")])
        return out.astype({"parent": "Int64", "extension": "Int64"})

    return dealt(r, "tree_id").groupBy("tree_id").applyInPandas(one, CYLINDER)


def adjust(points: DataFrame, cylinders: DataFrame, params: Params) -> DataFrame:
    """Radii within bounds, smoothed and tapered; starts fitted again where radii changed, continuous and on the parent's surface."""
    before = cylinders.select("tree_id", "cyl_id", F.col("radius").alias("old_radius"))
    c = corrections.smooth_radii(corrections.limit_radii(cylinders, params.parent_cor, params.min_cyl_rad))
    if params.taper_cor:
        c = corrections.taper_correction(c)
    c = cut(c.select(cylinders.columns))
    if params.growth_vol_cor:
        c = cut(c.drop("radius").join(corrections.growth_volume_correction(c, params.growth_vol_fac).select("tree_id", "cyl_id", "radius"), ["tree_id", "cyl_id"]).select(cylinders.columns))
    centred = kernels.recentred(points, c.join(before, ["tree_id", "cyl_id"], "left"))
    c = cut(c.drop("start_x", "start_y", "start_z").join(centred, ["tree_id", "cyl_id"]).select(cylinders.columns))
    moved = corrections.continuous_starts(c)
    c = cut(c.drop("start_x", "start_y", "start_z", "length").join(moved, ["tree_id", "cyl_id"]).select(cylinders.columns))
    hung = corrections.connect_to_parents(c)
    return cut(c.drop("start_x", "start_y", "start_z", "length", "axis_x", "axis_y", "axis_z").join(hung, ["tree_id", "cyl_id"]).select(cylinders.columns))


def first_stage(points: DataFrame, params: Params, seed: int | Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(centres, members, edges, segments) of the uniform cover; it serves every combination of the second cover's lengths.

    In clouds that hold more than the tree (not params.only_tree) a cylinder fitted to the points of the stem's squares tells
    the base from the ground, which becomes none of the tree's.
    """
    c, m, e = cover.cover(points, params.patch_diam1[0], params.ball_rad1[0], params.nmin1, seed)
    e = cut(e)
    if params.only_tree:
        base, ground = treesets.base_sets(c), None
    else:
        fits = cut(kernels.cylinder_fits(treesets.stem_points(points)).select("tree_id", "radius", *(f"{n}_{a}" for n in ("start", "axis") for a in "xyz")))
        base, ground = (cut(x) for x in treesets.base_and_ground(c, e, fits))
    return c, m, e, cut(segment_trees(c, e, base, params.patch_diam1[0], False, True, ground=ground))


def second_stage(points: DataFrame, first: tuple, params: Params, seed: int | Column) -> DataFrame:
    """Cylinders by the cover with sizes that follow the first segmentation."""
    c1, m1, e1, s1 = first
    tree = s1.select("tree_id", "seg_id", F.when(F.col("parent_seg") > 0, F.col("parent_seg")).alias("parent_seg")).distinct()
    rs = cut(cover.relative_size(s1.select("tree_id", "seg_id", "layer", "set_id"), tree, m1, e1, c1.select("tree_id", "set_id", "z")))
    c, m, e = cover.cover(points, params.patch_diam2_max[0], params.ball_rad2[0], params.nmin2, seed, rs, params.patch_diam2_min[0])
    e = cut(e)
    of_point = m1.join(s1.select("tree_id", "set_id", "seg_id"), ["tree_id", "set_id"]).groupBy("tree_id", "point_id").agg(F.min("seg_id").alias("seg_id"))
    of_set = cut(treesets.segment_of_sets(m, of_point))
    base = treesets.base_from_segments(c, of_set.filter("seg_id = 1"))
    main = of_set.join(treesets.main_segments(s1), ["tree_id", "seg_id"], "left_semi")
    s = cut(segment_trees(c, e, base, params.patch_diam2_max[0], True, False, main.select("tree_id", "set_id", "seg_id")))
    return adjust(points, cut(chain(cut(fit_cylinders(points, m, s)), s)), params)


def model_tables(points: DataFrame, cylinders: DataFrame, dist: bool = True, tria: bool = False) -> dict[str, DataFrame]:
    """The tables of models: cylinder, branch, attributes (totals, breast height diameter, place, crown), profile (spreads by
    layer), taper, distributions by class (cylinder_<by>, branch_<by>, branch_order) and, with `dist`, distances to the points;
    with `tria`, triangulation: facets of lower stems, whose measures are then among the attributes."""
    full = cut(branches.full_branch_table(cylinders))
    totals = cut(attributes.totals(cylinders).join(attributes.dbh_from_cylinders(cylinders), "tree_id"))
    surface = cut(attributes.model_points(cylinders))
    centre = attributes.centroids(surface)
    ids = surface.withColumn("point_id", F.xxhash64("cyl_id", "x", "y", "z"))
    crown = kernels.crowns(ids.select("tree_id", "point_id", "x", "y", "z"))
    place = attributes.location(cylinders).toDF("tree_id", "location_x", "location_y", "location_z")
    each = [place, attributes.crown_diameters(surface, centre), attributes.crown_base(full, cylinders, totals.select("tree_id", "tree_height", "dbh_qsm")), crown]
    for t in each:
        totals = totals.join(t, "tree_id", "left")
    facets = None
    if tria:
        on = pmdist.nearest_cylinder(points, cylinders).join(cylinders.filter("branch = 1").select("tree_id", "cyl_id"), ["tree_id", "cyl_id"], "left_semi")
        stem = points.join(on.select("tree_id", "point_id"), ["tree_id", "point_id"], "left_semi")
        facets = cut(kernels.triangulate_stems(stem, cylinders, full, totals.select("tree_id", "dbh_qsm")))
        totals = totals.join(kernels.stem_attributes(facets, totals.drop("dbh_qsm"), totals.select("tree_id", "dbh_qsm"), cylinders), "tree_id", "left")
    spreads = attributes.spreads(surface, centre)
    out = {"cylinder": cylinders, "branch": full, "attributes": totals, "profile": attributes.vertical_profile(spreads), "spreads": spreads, "taper": attributes.stem_taper(cylinders)}
    out |= {f"cylinder_{by}": distributions.cylinder_distribution(cylinders, by) for by in ("dia", "zen", "azi")}
    out |= {"cylinder_hei": distributions.cylinder_height_distribution(cylinders), "branch_order": distributions.branch_order_distribution(full)}
    out |= {f"branch_{by}": distributions.branch_distribution(full, by) for by in ("dia", "hei", "ang", "azi", "zen")}
    if facets is not None:
        out["triangulation"] = facets
    if dist:
        d = pmdist.trimmed_means(pmdist.nearest_cylinder(pmdist.sample_points(points), cylinders), cylinders)
        out["distance"] = pmdist.class_statistics(d.join(cylinders.select("tree_id", "cyl_id", "branch_order"), ["tree_id", "cyl_id"]))
    return out


def reconstruct(points: DataFrame, params: Params, seed: int | Column = 1) -> list[tuple[Params, DataFrame]]:
    """(combination, cylinders) of each combination of a sweep; the first stage is computed once for each first length."""
    out, known = [], {}
    for p in params.sweep():
        if p.patch_diam1 not in known:
            known[p.patch_diam1] = first_stage(points, p, seed)
        out.append((p, second_stage(points, known[p.patch_diam1], p, seed)))
    return out


def models_in_arrays(points: DataFrame, params: Params, repeats: int, tries: int) -> DataFrame:
    """make_models of trees that a task can hold: points are dealt out once, and only cylinders leave their task."""
    from .arrays import Trees

    combinations = [(p, (p.patch_diam1[0], p.patch_diam2_min[0], p.patch_diam2_max[0])) for p in params.sweep()]
    names, kinds = zip(*(n.split() for n in (CYLINDER + ", pd1 double, pd2min double, pd2max double, model long").split(", ")), strict=True)
    schema = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[k]) for n, k in zip(names, kinds, strict=True)])

    def run(t: pa.Table, tree: np.ndarray, xyz: np.ndarray) -> pa.Table:
        ids = t.column("point_id").to_numpy()
        order = np.lexsort((ids, tree))
        own, all_ = Trees(tree, ids[order], xyz[order]), t.column("tree_id").to_numpy()
        name, rows = all_[own.at[:-1]].tolist(), []
        for model in range(1, repeats + 1):
            left = np.ones(len(name), bool)
            for done in range(tries):
                got: set[int] = set()
                for p, lengths in combinations:
                    for code, found in own.models(p, model + 1000 * done, left).items():
                        got.add(code)
                        rows += [(name[code], *r[1:], *lengths, model) for r in found]
                left[[*got]] = False
                if not left.any():
                    break
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(names), schema, strict=True)], schema=schema)

    # a kernel's time goes by trees, not by bytes: Spark would merge partitions of few bytes into one task
    key, conf = "spark.sql.adaptive.coalescePartitions.enabled", points.sparkSession.conf
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut(by_tree(points.select("tree_id", "point_id", "x", "y", "z"), run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), MODEL_POINTS))
    finally:
        conf.set(key, before)


def make_models(points: DataFrame, params: Params, repeats: int = 5, tries: int = 5) -> DataFrame:
    """Cylinders with pd1, pd2min, pd2max and model of all combinations and repeats; repeats differ by their seed only.

    The repeats of all trees are modelled side by side, as trees of their own (tree * repeats + model - 1): a combination is one
    plan. Those that got no cylinder are tried again, up to `tries` times, with other seeds. Trees that a task can hold are
    modelled in arrays, all repeats and combinations where their points lie.
    """
    if params.only_tree and not params.growth_vol_cor:
        small, large = parted(points)
        parts = [models_in_arrays(small, params, repeats, tries)]
        if large is None:
            return parts[0]
        points = large
    else:
        parts = []
    key, model = F.col("tree_id"), F.expr(f"pmod(tree_id, {repeats})") + 1
    todo = points.withColumn("model", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).withColumn("tree_id", key * repeats + F.col("model") - 1).drop("model")
    for done in range(tries):
        found: list[DataFrame] = []
        for p, c in reconstruct(todo, params, model + 1000 * done):
            lengths = {"pd1": p.patch_diam1[0], "pd2min": p.patch_diam2_min[0], "pd2max": p.patch_diam2_max[0]}
            found.append(c.withColumns({n: F.lit(v) for n, v in lengths.items()}).withColumn("model", model.cast("long")))
        rows = cut(reduce(DataFrame.unionByName, found))
        parts.append(rows.withColumn("tree_id", F.expr(f"(tree_id - pmod(tree_id, {repeats})) div {repeats}")))
        if done + 1 == tries:
            break
        todo = cut(todo.join(rows.select("tree_id").distinct(), "tree_id", "left_anti"))
        if not todo.limit(1).count():
            break
    return reduce(DataFrame.unionByName, parts)
