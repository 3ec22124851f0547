"""Bases and trunks of trees among cover sets, by tables; the sequential parts are kernels in functions.forest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHRINKS = 5


def base_sets(sets: DataFrame) -> DataFrame:
    """(tree_id, set_id) of the base of sets (tree_id, set_id, x, y, z).

    The base is what lies below min(1.5 m, 2 % of the height) over the lowest set; while it is wider than 30 % of the tree
    (in x or y), the limit comes down by 5 cm, up to five times. The six limits are tried at once.
    """
    t = sets.groupBy("tree_id").agg(F.min("z").alias("low"), F.max("z").alias("high"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("wide"))
    t = t.withColumn("limit", F.least(F.lit(1.5), 0.02 * (F.col("high") - F.col("low")))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(SHRINKS))))
    t = t.withColumn("top", F.col("low") + F.col("limit") - 0.05 * F.col("step"))
    tried = sets.join(t.select("tree_id", "step", "top", "wide", "low"), "tree_id").filter((F.col("z") < F.col("top")) | (F.col("z") == F.col("low")))
    size = tried.groupBy("tree_id", "step", "wide").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("w"))
    chosen = size.groupBy("tree_id").agg(F.coalesce(F.min(F.when(F.col("w") <= 0.3 * F.col("wide"), F.col("step"))), F.max("step")).alias("step"))
    return tried.join(chosen, ["tree_id", "step"]).select("tree_id", "set_id")


def base_from_segments(sets: DataFrame, stem: DataFrame) -> DataFrame:
    """The base among the sets that an earlier segmentation gave to the stem (tree_id, set_id), by the first limit only."""
    on = sets.join(stem.select("tree_id", "set_id"), ["tree_id", "set_id"], "left_semi")
    t = on.groupBy("tree_id").agg(F.min("z").alias("low"))
    h = sets.groupBy("tree_id").agg((F.max("z") - F.min("z")).alias("h"))
    top = F.col("low") + F.least(F.lit(1.5), 0.02 * F.col("h"))
    return on.join(t, "tree_id").join(h, "tree_id").filter((F.col("z") < top) | (F.col("z") == F.col("low"))).select("tree_id", "set_id")


def segment_of_sets(member: DataFrame, points: DataFrame) -> DataFrame:
    """(tree_id, set_id, seg_id): the smallest segment among the points of each set, of points (tree_id, point_id, seg_id)."""
    return member.join(points, ["tree_id", "point_id"]).groupBy("tree_id", "set_id").agg(F.min("seg_id").alias("seg_id"))


def main_segments(segs: DataFrame, orders: int = 3) -> DataFrame:
    """(tree_id, seg_id) of the stem, which is segment 1, and of the branches up to so many orders, of (tree_id, seg_id,
    parent_seg) rows."""
    s = segs.select("tree_id", "seg_id", "parent_seg").distinct()
    out = level = s.filter("seg_id = 1").select("tree_id", "seg_id")
    for _ in range(orders):
        level = s.join(level.withColumnRenamed("seg_id", "parent_seg"), ["tree_id", "parent_seg"], "left_semi").select("tree_id", "seg_id")
        out = out.union(level)
    return out


def squares(points: DataFrame, edge_share: float = 0.015, widest: float = 0.1, classes: int = 10) -> DataFrame:
    """points with the square (ci, cj) that they stand in and their part of the height, 0 to classes - 1."""
    from .spatial import with_per_tree

    d = with_per_tree(points, *(f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"))
    h = F.col("hi_z") - F.col("lo_z")
    edge = F.least(F.lit(widest), edge_share * h)
    return d.withColumns({"ci": F.floor((F.col("x") - F.col("lo_x")) / edge).cast("long"), "cj": F.floor((F.col("y") - F.col("lo_y")) / edge).cast("long"), "part": F.least(F.lit(classes - 1), F.floor((F.col("z") - F.col("lo_z")) / h * classes))})


def ground_score(points: DataFrame, edge_share: float = 0.015, widest: float = 0.1, classes: int = 10) -> DataFrame:
    """(tree_id, ci, cj, score) of the squares of a plot that hold a stem: density times vertical occupancy times density near
    the ground, the mean over the 3 x 3 squares round each, relative to the highest; squares over 0.5 are stem candidates."""
    d = squares(points, edge_share, widest, classes)
    s = d.groupBy("tree_id", "ci", "cj").agg(F.count("*").alias("n"), (F.count_distinct("part") / classes).alias("full"), F.count(F.when(F.col("part") == 0, 1)).alias("low"))
    s = s.withColumn("raw", F.col("n") * F.col("full") * F.col("low"))
    near = s.withColumn("ci", F.explode(F.expr("sequence(ci - 1, ci + 1)"))).withColumn("cj", F.explode(F.expr("sequence(cj - 1, cj + 1)")))
    mean = near.groupBy("tree_id", "ci", "cj").agg((F.sum("raw") / 9).alias("mean")).join(s.select("tree_id", "ci", "cj"), ["tree_id", "ci", "cj"], "left_semi")
    top = mean.groupBy("tree_id").agg(F.max("mean").alias("top"))
    return mean.join(top, "tree_id").select("tree_id", "ci", "cj", F.coalesce(F.try_divide(F.col("mean"), F.col("top")), F.lit(0.0)).alias("score"))


def stem_points(points: DataFrame, lowest: float = 0.3, highest: float = 3.0, **how) -> DataFrame:
    """The points of the stem's squares and those beside them, from `lowest` to `highest` metres over the tree's lowest point."""
    from .spatial import stencil

    near = stencil(stem_squares(points, **how), 1, ("ci", "cj")).distinct()
    d = squares(points, **how).join(near, ["tree_id", "ci", "cj"], "left_semi")
    return d.filter((F.col("z") > F.col("lo_z") + lowest) & (F.col("z") < F.col("lo_z") + highest)).select("tree_id", "point_id", "x", "y", "z")


def stem_squares(points: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """(tree_id, ci, cj): the squares of the stem in a plot with ground: those that score over `least` and hang together, by
    their sides or corners, with the highest one."""
    from .graph import tree_components
    from .spatial import stencil

    s = ground_score(points, **how).filter(F.col("score") > least).withColumn("node", F.col("ci") * (1 << 24) + F.col("cj"))
    near = stencil(s.select("tree_id", "ci", "cj", F.col("node").alias("src")), 1, ("ci", "cj")).join(s.select("tree_id", "ci", "cj", F.col("node").alias("dst")), ["tree_id", "ci", "cj"]).filter("src <> dst")
    c = tree_components(near.select("tree_id", "src", "dst"), s.select("tree_id", "node"))
    d = s.join(c, ["tree_id", "node"])
    best = d.groupBy("tree_id").agg(F.max_by("component", F.struct("score", -F.col("node"))).alias("best"))
    return d.join(best, "tree_id").filter(F.col("component") == F.col("best")).select("tree_id", "ci", "cj")


def base_and_ground(sets: DataFrame, edges: DataFrame, axis: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, ground) sets of plots with ground, given each tree's fitted stem (tree_id, start_*, axis_*, radius).

    Base are the sets within 1.3 radii of the stem's axis in the lowest 2 % (1.5 m at most) over where the stem's lowest such
    set stands; ground is what the lowest set outside reaches over neighbours that lie no higher than that and off the stem.
    """
    from ..functions.vectors import distance_to_line, vec
    from .graph import flood

    d = sets.join(axis, "tree_id").withColumn("off", distance_to_line(vec(""), vec("axis"), vec("start")) / F.col("radius"))
    on = F.col("off") < 1.3
    t = d.groupBy("tree_id").agg(F.min(F.when(on, F.col("z"))).alias("foot"), F.least(F.lit(1.5), 0.02 * (F.max("z") - F.min("z"))).alias("limit"))
    d = d.join(t, "tree_id")
    low = F.col("z") < F.col("foot") + F.col("limit")
    base = d.filter(on & (low | (F.col("z") == F.col("foot")))).select("tree_id", "set_id")
    off = d.filter(~on)
    start = off.groupBy("tree_id").agg(F.min_by("set_id", F.struct("z", "set_id")).alias("node"))
    barred = d.filter(on | ~low).select("tree_id", F.col("set_id").alias("node"))
    ground = flood(edges, start.join(barred, ["tree_id", "node"], "left_anti"), barred)
    return base, ground.select("tree_id", F.col("node").alias("set_id"))
