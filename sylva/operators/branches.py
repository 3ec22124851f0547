"""The branch table of a cylinder model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import angle, clamp, vec

CYLINDER = ("radius", "length", "start_x", "start_y", "start_z", "axis_x", "axis_y", "axis_z")


def branch_table(cylinders: DataFrame) -> DataFrame:
    """(tree_id, branch, order, diameter, volume, area, length, height, azimuth, zenith): litres, m2, m and degrees; the
    order, diameter, height over the tree's base, and direction are those of the branch's first cylinder."""
    first = F.min_by(F.struct("branch_order", "radius", "start_z", "axis_x", "axis_y", "axis_z"), "position").alias("f")
    per = cylinders.groupBy("tree_id", "branch").agg(
        first,
        (1000 * F.pi() * F.sum(F.col("length") * F.col("radius") * F.col("radius"))).alias("volume"),
        (2 * F.pi() * F.sum(F.col("length") * F.col("radius"))).alias("area"),
        F.sum("length").alias("length"),
    )
    base = cylinders.groupBy("tree_id").agg(F.min_by("start_z", "cyl_id").alias("base"))
    return per.join(base, "tree_id").select(
        "tree_id",
        "branch",
        F.col("f.branch_order").alias("order"),
        (2 * F.col("f.radius")).alias("diameter"),
        "volume",
        "area",
        "length",
        (F.col("f.start_z") - F.col("base")).alias("height"),
        F.degrees(F.atan2("f.axis_y", "f.axis_x")).alias("azimuth"),
        F.degrees(F.acos(clamp(F.col("f.axis_z")))).alias("zenith"),
    )


def branch_angles(cylinders: DataFrame) -> DataFrame:
    """(tree_id, branch, angle): degrees between the branch's first cylinder (its second if the first was added to close a
    gap) and the cylinder that the first hangs on; 0 without one."""
    per = cylinders.groupBy("tree_id", "branch").agg(
        F.min_by(F.struct("parent", "added"), "position").alias("f"),
        F.min_by(F.struct("axis_x", "axis_y", "axis_z"), F.when(F.col("position") <= 1, F.col("position"))).alias("a1"),
        F.min_by(F.struct("axis_x", "axis_y", "axis_z"), F.when(F.col("position") >= 2, F.col("position"))).alias("a2"),
    )
    own = per.select("tree_id", "branch", F.col("f.parent").alias("parent"), F.when(F.col("f.added") & F.col("a2").isNotNull(), F.col("a2")).otherwise(F.col("a1")).alias("a")).select("tree_id", "branch", "parent", "a.*")
    on = cylinders.select("tree_id", F.col("cyl_id").alias("parent"), *(F.col(f"axis_{c}").alias(f"p_{c}") for c in "xyz"))
    return own.join(on, ["tree_id", "parent"], "left").select("tree_id", "branch", F.coalesce(angle(vec("axis"), vec("p")), F.lit(0.0)).alias("angle"))


def branch_parents(cylinders: DataFrame) -> DataFrame:
    """(tree_id, branch, parent): the branch that owns the cylinder on which the branch's first one hangs, without being
    its extension; null for the trunk."""
    child = cylinders.select("tree_id", "branch", F.col("cyl_id").alias("child"), F.col("parent").alias("on"))
    owner = cylinders.select("tree_id", F.col("cyl_id").alias("on"), F.col("branch").alias("owner"), "extension")
    link = child.join(owner, ["tree_id", "on"]).filter(~F.col("extension").eqNullSafe(F.col("child"))).groupBy("tree_id", "branch").agg(F.min_by("owner", "child").alias("parent"))
    return cylinders.select("tree_id", "branch").distinct().join(link, ["tree_id", "branch"], "left").select("tree_id", "branch", "parent")


def full_branch_table(cylinders: DataFrame) -> DataFrame:
    """The branch table with angle and parent."""
    return branch_table(cylinders).join(branch_angles(cylinders), ["tree_id", "branch"]).join(branch_parents(cylinders), ["tree_id", "branch"])
