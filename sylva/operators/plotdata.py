"""The data behind plots; drawing them is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import basis, rotate, vec
from .graph import descendants


def relative_and_cumulative(distribution: DataFrame, value: str) -> DataFrame:
    """(tree_id, class, value, relative, cumulative): percent of the tree's sum, and their running sum over the classes."""
    w = Window.partitionBy("tree_id")
    total = F.sum(value).over(w)
    d = distribution.select("tree_id", "class", F.col(value).alias("value"), F.coalesce(F.try_divide(F.col(value), total) * 100, F.lit(0.0)).alias("relative"))
    return d.withColumn("cumulative", F.sum("relative").over(w.orderBy("class").rowsBetween(Window.unboundedPreceding, 0)))


def relative_spreads(spreads: DataFrame) -> DataFrame:
    """(tree_id, layer, direction, relative) to the tree's largest spread; a ring is closed by the first direction, as 19."""
    d = spreads.withColumn("relative", F.coalesce(F.try_divide(F.col("spread"), F.max("spread").over(Window.partitionBy("tree_id"))), F.lit(0.0))).select("tree_id", "layer", "direction", "relative")
    return d.unionByName(d.filter("direction = 1").withColumn("direction", F.lit(19).cast("long")))


def facet_counts(cylinders: DataFrame, most: int = 20) -> DataFrame:
    """(tree_id, cyl_id, facets): sides by the root of the radius relative to the first cylinder's, 4 to `most`."""
    first = cylinders.groupBy("tree_id").agg(F.min_by("radius", "cyl_id").alias("r1"))
    n = F.ceil(F.sqrt(F.col("radius") / F.col("r1")) * most)
    return cylinders.join(first, "tree_id").select("tree_id", "cyl_id", F.least(F.lit(most), F.greatest(F.lit(4), n)).cast("long").alias("facets"))


def cylinder_vertices(cylinders: DataFrame, most: int = 20) -> DataFrame:
    """(tree_id, cyl_id, ring, side, x, y, z): the vertices of each cylinder's bottom (ring 0) and top (ring 1)."""
    c = cylinders.join(facet_counts(cylinders, most), ["tree_id", "cyl_id"]).withColumn("ring", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("side", F.explode(F.expr("sequence(0L, facets - 1)")))
    u, _ = basis(vec("axis"))
    at = vec("start") + vec("axis").scale(F.col("ring") * F.col("length")) + rotate(u, vec("axis"), 2 * F.pi() * F.col("side") / F.col("facets")).scale(F.col("radius"))
    return c.select("tree_id", "cyl_id", "ring", "side", *(a.alias(n) for a, n in zip(at, "xyz", strict=True)))


def cones(cylinders: DataFrame, tip: float = 0.005) -> DataFrame:
    """(tree_id, branch, position, bottom, top): radii of truncated cones; a cone narrows to the next cylinder's radius, the
    last one to `tip` at most."""
    w = Window.partitionBy("tree_id", "branch").orderBy("position")
    return cylinders.select("tree_id", "branch", "position", F.col("radius").alias("bottom"), F.coalesce(F.lead("radius").over(w), F.least("radius", F.lit(tip))).alias("top"))


def subtree(branches: DataFrame, root: int, most_order: int) -> DataFrame:
    """(tree_id, branch, order) of a branch and what hangs on it, up to so many orders above its own."""
    b = branches.select("tree_id", F.col("branch").alias("node"), "parent", "order")
    own = b.filter(F.col("node") == root).select("tree_id", F.col("order").alias("root_order"))
    found = descendants(b, b.filter(F.col("node") == root)).join(b, ["tree_id", "node"]).join(own, "tree_id")
    return found.filter(F.col("order") - F.col("root_order") <= most_order).select("tree_id", F.col("node").alias("branch"), "order")


def disjoint_subsets(members: DataFrame) -> DataFrame:
    """(tree_id, point_id, subset): each point in the first of the subsets that hold it."""
    return members.groupBy("tree_id", "point_id").agg(F.min("subset").alias("subset"))


def difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """The distinct rows of second that first lacks."""
    return second.subtract(first)


def thinned(points: DataFrame, percent: float, seed: int = 1) -> DataFrame:
    """About so many percent of the points, by a hash of their ids."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "tree_id", "point_id").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return points.filter(draw < percent / 100)
