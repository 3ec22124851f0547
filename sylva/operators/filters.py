"""Point filters. Each gives the points that stay, or one row a point with its verdict, keyed by point_id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import neighbours
from ..functions.vectors import safe_std
from ..plans.lineage import cut
from .spatial import AXES, by_tree, ids_of, kth_distance_joined, parted, radius_join, with_cells, with_per_tree


def valid_points(points: DataFrame) -> DataFrame:
    """Points without NaN or null coordinates."""
    bad = F.lit(False)
    for c in "xyz":
        bad = bad | F.isnan(c) | F.col(c).isNull()
    return points.filter(~bad)


def layered(df: DataFrame, value: str, sigmas: float, above: bool) -> DataFrame:
    """df and `keep`: `value` lies below mean + sigmas * deviation of its 1 m layer of the tree (or, `above`, over mean -
    sigmas * deviation). Layers are half-open: a tree of whole metres has its top points in none, and they go."""
    df = with_per_tree(df, F.min("z").alias("low"), F.max("z").alias("high")).withColumn("layer", F.floor(F.col("z") - F.col("low")).cast("long"))
    inside = F.col("layer") < F.ceil(F.col("high") - F.col("low"))
    stats = df.filter(inside).groupBy("tree_id", "layer").agg(F.avg(value).alias("mean"), safe_std(F.col(value)).alias("std"))
    test: Column = F.col(value) > F.col("mean") - sigmas * F.col("std") if above else F.col(value) < F.col("mean") + sigmas * F.col("std")
    return df.join(stats, ["tree_id", "layer"], "left").withColumn("keep", F.coalesce(test, F.lit(False))).drop("low", "high", "mean", "std")


def knn_outliers(points: DataFrame, k: int = 10, sigmas: float = 1.5, edge: float = 0.2) -> DataFrame:
    """(tree_id, point_id, layer, distance, keep): the distance to the k-th nearest point, itself counted, against its layer's."""
    points, large = parted(points)

    def run(t: pa.Table, tree: np.ndarray, xyz: np.ndarray) -> pa.Table:
        d = neighbours.kth(tree, xyz, k, edge)
        layer, keep = neighbours.layered(tree, xyz[:, 2], d, sigmas, above=False)
        return pa.table(ids_of(t) | {"layer": layer, "distance": pa.array(d, from_pandas=True), "keep": keep})

    out = by_tree(points.select("tree_id", "point_id", *AXES), run, "tree_id long, point_id long, layer long, distance double, keep boolean")
    return out if large is None else out.union(knn_outliers_joined(large, k, sigmas, edge))


def knn_outliers_joined(points: DataFrame, k: int, sigmas: float, edge: float) -> DataFrame:
    """knn_outliers of trees of any size, by joins of cells."""
    d = kth_distance_joined(points, k, edge)
    z = points.select("tree_id", "point_id", "z")
    return layered(cut(z.join(d, ["tree_id", "point_id"])), "distance", sigmas, above=False).select("tree_id", "point_id", "layer", "distance", "keep")


def density_outliers(points: DataFrame, radius2: float, sigmas: float = 1.5) -> DataFrame:
    """(tree_id, point_id, layer, neighbours, keep): points nearer than the radius, itself counted, against its layer's mean."""
    points, large = parted(points)

    def run(t: pa.Table, tree: np.ndarray, xyz: np.ndarray) -> pa.Table:
        n, _ = neighbours.counts(tree, xyz, radius2, radius2**0.5)
        layer, keep = neighbours.layered(tree, xyz[:, 2], n, sigmas, above=True)
        return pa.table(ids_of(t) | {"layer": layer, "neighbours": n, "keep": keep})

    out = by_tree(points.select("tree_id", "point_id", *AXES), run, "tree_id long, point_id long, layer long, neighbours long, keep boolean")
    return out if large is None else out.union(density_outliers_joined(large, radius2, sigmas))


def density_outliers_joined(points: DataFrame, radius2: float, sigmas: float) -> DataFrame:
    """density_outliers of trees of any size, by joins of cells."""
    edge = radius2**0.5 * (1 + 1e-9)
    g = with_cells(points, (edge,) * 3)
    near = radius_join(g, g.select("tree_id", "x", "y", "z", "ci", "cj", "ck"), radius2, edge)
    n = near.groupBy(F.col("a.tree_id").alias("tree_id"), F.col("a.point_id").alias("point_id")).agg(F.count("*").alias("neighbours"), F.first("a.z").alias("z"))
    return layered(cut(n), "neighbours", sigmas, above=True).select("tree_id", "point_id", "layer", "neighbours", "keep")


def voxel_downsample(points: DataFrame, edge: float) -> DataFrame:
    """The point of smallest id of each cell."""
    first = with_cells(points, (edge,) * 3).groupBy("tree_id", "ci", "cj", "ck").agg(F.min(F.struct("point_id", "x", "y", "z")).alias("p"))
    return first.select("tree_id", "p.*")


def voxel_average(points: DataFrame, edge: float) -> DataFrame:
    """The mean of the points of each cell, and how many they are."""
    return with_cells(points, (edge,) * 3).groupBy("tree_id", "ci", "cj", "ck").agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"))


def summary(kept: DataFrame) -> DataFrame:
    """(tree_id, total, removed, remaining, percent) of rows with `keep`; percent removed, to one decimal."""
    n = F.count("*")
    left = F.count(F.when(F.col("keep"), 1))
    return kept.groupBy("tree_id").agg(n.alias("total"), (n - left).alias("removed"), left.alias("remaining"), F.round((n - left) / n * 100, 1).alias("percent"))
