"""Cover sets: patches of a surface, each of the points nearest to its centre.

Trees that a task can hold are covered in arrays, many at once; for larger ones the same is done by joins. The centres are what a pass over the points in a random order would choose: a point that no earlier centre covers. With
the order fixed by a hash, that is the lexicographically first maximal independent set, which rounds of joins find: in
each, every undecided point that no earlier undecided point could cover becomes a centre, and what new centres cover is
out. Few rounds are needed for random orders, and the result is that of the serial pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import neighbours as near_by
from ..plans.lineage import cut
from .spatial import AXES, by_tree, d2, parted, radius_join, stencil, with_cells


def order_of(seed: int | Column) -> Column:
    """A random order of points that is the same everywhere: by md5 of seed and id. The seed may be a column."""
    return F.md5(F.concat_ws(":", F.lit(seed) if isinstance(seed, int) else seed.cast("string"), "point_id").cast("binary"))


def sizes(points: DataFrame, patch: float, ball: float, relative: DataFrame | Column | None = None, smallest: float | None = None, every: bool = False) -> DataFrame:
    """points with max_dist and ball: equal ones, or by relative size rs (0 to 256; 0 leaves a point out, with `every` its sizes
    null) between `smallest` and `patch`, and with the class of the order in which points are visited, small sizes first.
    relative: (tree_id, point_id, rs), or rs as an expression of the points' columns."""
    if relative is None:
        return points.withColumns({"max_dist": F.lit(patch), "ball": F.lit(ball), "class": F.lit(0)})
    share = smallest / patch
    rs = F.col("rs") / 256 * (1 - share) + share
    near = patch * rs
    if isinstance(relative, Column):
        d = points.withColumn("rs", F.when(relative > 0, relative))
        d = d if every else d.filter("rs is not null")
    else:
        d = points.join(relative.filter("rs > 0").select("tree_id", "point_id", "rs"), ["tree_id", "point_id"], "left" if every else "inner")
    return d.withColumns({"max_dist": near, "ball": near + F.sqrt(rs) * (ball - patch), "class": F.when(F.col("rs") <= 32, 0).when(F.col("rs") <= 128, 1).otherwise(2)})


def in_order(points: DataFrame, patch: float, ball: float, seed: int | Column, relative: DataFrame | Column | None, smallest: float | None, every: bool) -> DataFrame:
    """points with their sizes and the order `prio` in which they are visited."""
    p = sizes(points, patch, ball, relative, smallest, every).withColumn("prio", F.concat(F.col("class").cast("string"), order_of(seed)))
    return p.select("tree_id", "point_id", *AXES, "max_dist", "ball", "prio")


def ranks(t: pa.Table) -> np.ndarray:
    order = pc.sort_indices(t.select(["prio", "point_id"]), sort_keys=[("prio", "ascending"), ("point_id", "ascending")]).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def covered(t: pa.Table, tree: np.ndarray, xyz: np.ndarray, nmin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return near_by.cover(tree, xyz, ranks(t), *(t.column(c).to_numpy().astype(float) for c in ("max_dist", "ball")), nmin)


def set_rows(t: pa.Table, at: np.ndarray) -> dict[str, pa.ChunkedArray]:
    c = t.take(pa.array(at))
    return {"tree_id": c.column("tree_id"), "set_id": c.column("point_id")} | {n: c.column(n) for n in (*AXES, "ball", "prio")}


SET = "tree_id long, set_id long, x double, y double, z double, ball double, prio string"


def centres(points: DataFrame, patch: float, ball: float, nmin: int, seed: int | Column = 1, relative: DataFrame | Column | None = None, smallest: float | None = None) -> DataFrame:
    """(tree_id, set_id, x, y, z, ball, prio): the centres, set_id their point's id. A centre has at least nmin points nearer
    than its ball's radius, itself counted, and no earlier centre nearer than that one's max_dist."""
    points, large = parted(points)

    def run(t: pa.Table, tree: np.ndarray, xyz: np.ndarray) -> pa.Table:
        reach, size = (t.column(c).to_numpy() for c in ("max_dist", "ball"))
        return pa.table(set_rows(t, near_by.first_independent(tree, xyz, ranks(t), reach, size, nmin)))

    out = by_tree(in_order(points, patch, ball, seed, relative, smallest, False), run, SET)
    return out if large is None else out.union(centres_joined(large, patch, ball, nmin, seed, relative, smallest))


def centres_joined(points: DataFrame, patch: float, ball: float, nmin: int, seed: int | Column = 1, relative: DataFrame | Column | None = None, smallest: float | None = None) -> DataFrame:
    """centres of trees of any size, by joins of cells."""
    p = sizes(points, patch, ball, relative, smallest).withColumn("prio", F.concat(F.col("class").cast("string"), order_of(seed)))
    g = cut(with_cells(p, (ball,) * 3).select("tree_id", "point_id", "x", "y", "z", "max_dist", "ball", "prio", "ci", "cj", "ck"))
    square = g.withColumn("ball2", F.col("ball") * F.col("ball"))
    near = radius_join(square, g.select("tree_id", "point_id", "x", "y", "z", "prio", "ci", "cj", "ck"), "ball2", ball)
    dense = cut(near.groupBy("a.tree_id", "a.point_id").agg(F.count("*").alias("n")).filter(F.col("n") >= nmin).select(F.col("tree_id").alias("t"), F.col("point_id").alias("p")))
    ok = cut(g.join(dense, (F.col("tree_id") == F.col("t")) & (F.col("point_id") == F.col("p")), "left_semi"))
    # earlier -> later point that it covers
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("tree_id", "ci", "cj", "ck")]
    covers = ok.alias("a").join(stencil(ok, 1).alias("b"), keys).filter((d2("a", "b") < F.col("a.max_dist") * F.col("a.max_dist")) & (F.struct("a.prio", "a.point_id") < F.struct("b.prio", "b.point_id")))
    covers = cut(covers.select("a.tree_id", F.col("a.point_id").alias("src"), F.col("b.point_id").alias("dst")))
    left, found = cut(ok.select("tree_id", "point_id")), None
    while True:
        blocked = covers.select("tree_id", F.col("dst").alias("point_id")).distinct()
        new = cut(left.join(blocked, ["tree_id", "point_id"], "left_anti"))
        found = new if found is None else cut(found.union(new))
        gone = covers.join(new.withColumnRenamed("point_id", "src"), ["tree_id", "src"], "left_semi").select("tree_id", F.col("dst").alias("point_id"))
        left = cut(left.join(gone.union(new).distinct(), ["tree_id", "point_id"], "left_anti"))
        if not left.limit(1).count():
            break
        for end in ("src", "dst"):
            covers = covers.join(left.withColumnRenamed("point_id", end), ["tree_id", end], "left_semi")
        covers = cut(covers)
    return ok.join(found, ["tree_id", "point_id"], "left_semi").select("tree_id", F.col("point_id").alias("set_id"), "x", "y", "z", "ball", "prio")


def balls(points: DataFrame, centre: DataFrame, largest: float) -> DataFrame:
    """(tree_id, set_id, point_id, distance2, prio): all points nearer to a centre than its ball's radius."""
    g = with_cells(points, (largest,) * 3).select("tree_id", "point_id", "x", "y", "z", "ci", "cj", "ck")
    low = points.groupBy("tree_id").agg(*(F.min(c).alias(f"low_{c}") for c in "xyz"))
    c = centre.join(low, "tree_id").withColumns({n: F.floor((F.col(a) - F.col(f"low_{a}")) / largest).cast("long") for n, a in zip(("ci", "cj", "ck"), "xyz", strict=True)})
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("tree_id", "ci", "cj", "ck")]
    near = stencil(c, 1).alias("a").join(g.alias("b"), keys).withColumn("distance2", d2("a", "b")).filter(F.col("distance2") < F.col("a.ball") * F.col("a.ball"))
    return near.select("a.tree_id", "a.set_id", "b.point_id", "distance2", "a.prio")


def members(ball: DataFrame) -> DataFrame:
    """(tree_id, point_id, set_id): each point's nearest centre among the balls that hold it, the earlier one at equal distance."""
    first = F.min(F.struct("distance2", "prio", "set_id")).alias("m")
    return ball.groupBy("tree_id", "point_id").agg(first).select("tree_id", "point_id", "m.set_id")


def neighbours(ball: DataFrame, member: DataFrame) -> DataFrame:
    """(tree_id, src, dst), both ways: sets whose ball holds a point of another set."""
    meet = ball.select("tree_id", F.col("set_id").alias("src"), "point_id").join(member.select("tree_id", "point_id", F.col("set_id").alias("dst")), ["tree_id", "point_id"])
    one = meet.filter("src <> dst").select("tree_id", "src", "dst").distinct()
    return one.union(one.select("tree_id", F.col("dst"), F.col("src"))).distinct()


def cover(points: DataFrame, patch: float, ball: float, nmin: int = 3, seed: int | Column = 1, relative: DataFrame | None = None, smallest: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(centres, members, neighbours) of a cover with one patch size, or with sizes by `relative` (tree_id, point_id, rs)."""
    points, large = parted(points)
    p = in_order(points, patch, ball, seed, relative, smallest, True)

    def sets(t: pa.Table, tree: np.ndarray, xyz: np.ndarray) -> pa.Table:
        at, _, src, dst = covered(t, tree, xyz, nmin)
        ids = t.column("point_id").to_numpy()[at]
        near = pa.ListArray.from_arrays(pa.array(np.searchsorted(src, np.arange(len(at) + 1)), pa.int32()), pa.array(ids[dst], pa.int64()))
        return pa.table(set_rows(t, at) | {"near": near})

    def own(t: pa.Table, tree: np.ndarray, xyz: np.ndarray) -> pa.Table:
        at, member, _, _ = covered(t, tree, xyz, nmin)
        held = np.flatnonzero(member >= 0)
        ids = t.column("point_id").to_numpy()
        return pa.table({"tree_id": t.column("tree_id").take(pa.array(held)), "point_id": ids[held], "set_id": ids[at[member[held]]]})

    s = cut(by_tree(p, sets, SET + ", near array<long>"))
    out = s.drop("near"), by_tree(p, own, "tree_id long, point_id long, set_id long"), s.select("tree_id", F.col("set_id").alias("src"), F.explode("near").alias("dst"))
    if large is None:
        return out
    c = cut(centres_joined(large, patch, ball, nmin, seed, relative, smallest))
    b = cut(balls(large, c, ball))
    m = cut(members(b))
    return out[0].union(c), out[1].union(m), out[2].union(neighbours(b, m))


def small_components(points: DataFrame, patch: float, ball: float, ncomp: int, seed: int | Column = 1) -> DataFrame:
    """The points of components of at least ncomp sets in a cover that every point takes part in."""
    from .graph import tree_components

    points, large = parted(points)
    names, kinds = points.columns, dict(points.dtypes)

    def run(t: pa.Table, tree: np.ndarray, xyz: np.ndarray) -> pa.Table:
        at, member, src, dst = covered(t, tree, xyz, 0)
        label = near_by.components(len(at), src, dst)
        kept = np.bincount(label, minlength=len(at))[label] >= ncomp
        return t.select(names).filter(pa.array((member >= 0) & kept[member]))

    p = points.withColumns({"max_dist": F.lit(patch), "ball": F.lit(ball), "prio": F.concat(F.lit("0"), order_of(seed))})
    out = by_tree(p, run, ", ".join(f"`{n}` {kinds[n]}" for n in names))
    if large is None:
        return out
    c = cut(centres_joined(large, patch, ball, 0, seed))
    b = cut(balls(large, c, ball))
    m = cut(members(b))
    kept = tree_components(neighbours(b, m), c.select("tree_id", F.col("set_id").alias("node")), ncomp)
    in_kept = m.join(kept.select("tree_id", F.col("node").alias("set_id")), ["tree_id", "set_id"], "left_semi")
    return out.union(large.join(in_kept.select("tree_id", "point_id"), ["tree_id", "point_id"], "left_semi"))


def relative_size(layers: DataFrame, children: DataFrame, member: DataFrame, edges: DataFrame, heights: DataFrame) -> DataFrame:
    """(tree_id, point_id, rs): relative sizes 1 to 256 that shrink along segments.

    layers: (tree_id, seg_id, layer from 1, set_id), the stem being segment 1; children: (tree_id, seg_id, parent_seg); member:
    (tree_id, point_id, set_id); edges: (tree_id, src, dst); heights: (tree_id, set_id, z). A segment starts at the mean size
    of its layers 2 to 6 (of its only one) relative to the stem's, 256 at most by the height of its base in the tree, and
    falls with the root of the layer's place; round the bases of child segments, outside their second layer, it is halved.
    """
    per = layers.groupBy("tree_id", "seg_id", "layer").agg(F.count("*").alias("n"))
    seg = per.groupBy("tree_id", "seg_id").agg(F.max("layer").alias("s"), F.avg(F.when(F.col("layer").between(2, 6), F.col("n"))).alias("mean"), F.max(F.when(F.col("layer") == 1, F.col("n"))).alias("first"))
    seg = seg.withColumn("width", F.coalesce("mean", F.col("first").cast("double")))
    stem = seg.filter("seg_id = 1").select("tree_id", F.col("width").alias("stem"))
    tree = heights.groupBy("tree_id").agg(F.min("z").alias("low"), (F.max("z") - F.min("z")).alias("h"))
    base = layers.filter("layer = 1").join(heights, ["tree_id", "set_id"]).groupBy("tree_id", "seg_id").agg(F.min("z").alias("base"))
    seg = seg.join(stem, "tree_id").join(tree, "tree_id").join(base, ["tree_id", "seg_id"])
    raw = F.try_divide(F.col("width"), F.col("stem")) * 256
    raw = F.when(F.col("s") >= 2, F.ceil(raw)).otherwise(raw)
    most = F.ceil(256 * F.coalesce(F.try_divide(F.col("h") - (F.col("base") - F.col("low")), F.col("h")), F.lit(1.0)))
    seg = seg.withColumn("size", F.when(F.col("seg_id") == 1, 256.0).otherwise(F.least(raw, most)))
    sets = layers.join(seg.select("tree_id", "seg_id", "s", "size"), ["tree_id", "seg_id"]).withColumn("rs", F.col("size") - (F.col("size") - 1) * F.sqrt((F.col("layer") - 1) / F.col("s")))
    first = layers.filter("layer = 1").join(children.filter("parent_seg is not null").select("tree_id", "seg_id"), ["tree_id", "seg_id"], "left_semi")
    second = layers.filter("layer = 2").select("tree_id", "seg_id", F.col("set_id").alias("dst"))
    round_ = first.join(edges.withColumnRenamed("src", "set_id"), ["tree_id", "set_id"]).select("tree_id", "seg_id", "dst").join(second, ["tree_id", "seg_id", "dst"], "left_anti")
    halved = round_.select("tree_id", F.col("dst").alias("set_id")).union(first.select("tree_id", "set_id")).distinct().withColumn("half", F.lit(True))
    out = sets.join(halved, ["tree_id", "set_id"], "left").withColumn("rs", F.least(F.lit(255), F.round(F.when(F.col("half"), F.round("rs") / 2).otherwise(F.col("rs"))).cast("int")))
    return member.join(out.groupBy("tree_id", "set_id").agg(F.max("rs").alias("rs")), ["tree_id", "set_id"]).select("tree_id", "point_id", F.greatest("rs", F.lit(1)).alias("rs"))
