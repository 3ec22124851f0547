"""Distances of points to the nearest cylinder of their tree's model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import distance_to_line, height_on_line, safe_std, vec
from ..plans.lineage import broadcast_below, cut

FAR = 0.5
BEYOND = 0.1


def sample_points(points: DataFrame, fraction: float = 0.25, most: int = 1_000_000, seed: int = 1) -> DataFrame:
    """The points of each tree whose hash falls below min(fraction, most / points of the tree): the same ones in every run."""
    from .spatial import with_per_tree

    d = with_per_tree(points, F.count("*").alias("n"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "tree_id", "point_id").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return d.filter(draw < F.least(F.lit(fraction), F.lit(float(most)) / F.col("n"))).drop("n")


def nearest_cylinder(points: DataFrame, cylinders: DataFrame, edge: float = 1.0) -> DataFrame:
    """(tree_id, point_id, cyl_id, distance): the cylinder whose surface is nearest, by |distance to the axis - radius| below FAR.

    Points beside the axis compete with those up to BEYOND past its ends; at equal distance beside goes first, then the
    smaller id. Points without such a cylinder are left out. Cylinders go to the cells round their bounding box, points to
    their own. Only trees of both are joined; those that a task can hold are dealt out whole, and their cylinders copied to
    cells after that, not before.
    """
    from .spatial import BROADCAST_TREES, parted

    trees = broadcast_below(cut(points.select("tree_id").distinct()), BROADCAST_TREES)
    cylinders = cylinders.join(trees, "tree_id", "left_semi")
    small, large = parted(points)
    points.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # trees that lie together are joined there, cell by cell
    near = nearest_joined(small.repartition("tree_id"), cylinders.repartition("tree_id"), edge)
    return near if large is None else near.union(nearest_joined(large, cylinders, edge))


def nearest_in_arrays(p: np.ndarray, start: np.ndarray, axis: np.ndarray, radius: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest cylinder as nearest_cylinder has it, or -1; its distance) of the points of one tree, whose cylinders come
    in the order of their ids."""
    on, best = np.full(len(p), -1), np.full(len(p), np.inf)
    for lo in range(0, len(p) if len(radius) else 0, rows := max(1, (1 << 18) // max(1, len(radius)))):
        v = [p[lo : lo + rows, i, None] - start[:, i] for i in range(3)]
        h = v[0] * axis[:, 0] + v[1] * axis[:, 1] + v[2] * axis[:, 2]
        x, y, z = (v[i] - h * axis[:, i] for i in range(3))
        d = np.abs(np.sqrt(x * x + y * y + z * z) - radius)
        d[~((d < FAR) & (h >= -BEYOND) & (h <= length + BEYOND))] = np.inf
        least = d.min(1)
        past = np.where(d == least[:, None], np.where((h >= 0) & (h <= length), 0, 1), 2).argmin(1)
        on[lo : lo + rows], best[lo : lo + rows] = np.where(np.isfinite(least), past, -1), least
    return on, best


def nearest_joined(points: DataFrame, cylinders: DataFrame, edge: float) -> DataFrame:
    """nearest_cylinder by a join of cells."""
    c = cylinders.select("tree_id", "cyl_id", "radius", "length", *(f"start_{a}" for a in "xyz"), *(f"axis_{a}" for a in "xyz"))
    p = points.select("tree_id", "point_id", "x", "y", "z")
    cell = {f"c{a}": F.floor(F.col(a) / edge).cast("long") for a in "xyz"}
    p = p.withColumns(cell)
    for a in "xyz":
        s, e = F.col(f"start_{a}"), F.col(f"start_{a}") + F.col("length") * F.col(f"axis_{a}")
        reach = F.col("radius") + FAR + BEYOND
        c = c.withColumn(f"c{a}", F.explode(F.sequence(F.floor((F.least(s, e) - reach) / edge).cast("long"), F.floor((F.greatest(s, e) + reach) / edge).cast("long"))))
    pair = p.join(c, ["tree_id", "cx", "cy", "cz"])
    at, axis, start = vec(""), vec("axis"), vec("start")
    h = height_on_line(at, axis, start)
    pair = pair.select("tree_id", "point_id", "cyl_id", "length", h.alias("h"), F.abs(distance_to_line(at, axis, start) - F.col("radius")).alias("d"))
    beside = (F.col("h") >= 0) & (F.col("h") <= F.col("length"))
    near = pair.filter((F.col("d") < FAR) & (F.col("h") >= -BEYOND) & (F.col("h") <= F.col("length") + BEYOND))
    best = F.min(F.struct("d", F.when(beside, 0).otherwise(1).alias("past"), "cyl_id")).alias("m")
    return near.groupBy("tree_id", "point_id").agg(best).select("tree_id", "point_id", "m.cyl_id", F.col("m.d").alias("distance"))


def trimmed_means(nearest: DataFrame, cylinders: DataFrame) -> DataFrame:
    """(tree_id, cyl_id, mean_distance): of the 95 % smallest distances if over 19 points are nearest, of all if fewer, 0 if none."""
    w = Window.partitionBy("tree_id", "cyl_id")
    ranked = nearest.withColumns({"rank": F.row_number().over(w.orderBy("distance", "point_id")), "n": F.count("*").over(w)})
    kept = ranked.filter((F.col("n") <= 19) | (F.col("rank") <= F.floor(F.col("n") * 95 / 100)))
    per = kept.groupBy("tree_id", "cyl_id").agg(F.avg("distance").alias("m"))
    return cylinders.select("tree_id", "cyl_id").join(per, ["tree_id", "cyl_id"], "left").select("tree_id", "cyl_id", F.coalesce("m", F.lit(0.0)).alias("mean_distance"))


CLASSES = {"all": "true", "trunk": "branch_order = 0", "branch": "branch_order > 0", "branch1": "branch_order = 1", "branch2": "branch_order = 2"}


def class_statistics(per_cylinder: DataFrame) -> DataFrame:
    """One row a tree of (tree_id, cyl_id, branch_order, mean_distance): median, mean, max and std of each of CLASSES; 0 for none."""
    aggs = []
    for name, test in CLASSES.items():
        v = F.when(F.expr(test), F.col("mean_distance"))
        aggs += [F.coalesce(f(v), F.lit(0.0)).alias(f"{name}_{n}") for n, f in (("median", F.median), ("mean", F.avg), ("max", F.max), ("std", safe_std))]
    return per_cylinder.groupBy("tree_id").agg(*aggs)
