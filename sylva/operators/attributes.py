"""Attributes of whole trees from their cylinders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import basis, rotate, vec
from .spatial import with_per_tree

#: Unit of an attribute by the start of its name.
UNITS = {"volume": "L", "area": "m^2", "length": "m", "height": "m", "diameter": "m", "dbh": "m", "diam": "m", "number": "", "order": "", "ratio": ""}


def volume(on: Column | None = None) -> Column:
    v = F.col("length") * F.col("radius") * F.col("radius")
    return 1000 * F.pi() * F.sum(v if on is None else F.when(on, v).otherwise(0.0))


def area(on: Column | None = None) -> Column:
    a = F.col("length") * F.col("radius")
    return 2 * F.pi() * F.sum(a if on is None else F.when(on, a).otherwise(0.0))


def length(on: Column | None = None) -> Column:
    return F.sum(F.col("length") if on is None else F.when(on, F.col("length")).otherwise(0.0))


def totals(cylinders: DataFrame) -> DataFrame:
    """Volumes (litres), areas, lengths, height, number of branches besides the trunk (branch 1) and largest order of each tree.

    One pass: partial sums by tree. The height runs from the lowest start to the end of the cylinder that starts highest,
    or to its start if it points down.
    """
    trunk = F.col("branch") == 1
    top = F.max_by(F.struct("start_z", F.greatest(F.lit(0.0), F.col("length") * F.col("axis_z")).alias("up")), F.struct("start_z", "cyl_id"))
    t = cylinders.groupBy("tree_id").agg(
        volume().alias("total_volume"),
        volume(trunk).alias("trunk_volume"),
        volume(~trunk).alias("branch_volume"),
        top.alias("top"),
        F.min("start_z").alias("low"),
        length(trunk).alias("trunk_length"),
        length(~trunk).alias("branch_length"),
        length().alias("total_length"),
        (F.count_distinct("branch") - 1).alias("number_branches"),
        F.max("branch_order").alias("max_branch_order"),
        area(trunk).alias("trunk_area"),
        area(~trunk).alias("branch_area"),
        area().alias("total_area"),
    )
    return t.withColumn("tree_height", F.col("top.start_z") + F.col("top.up") - F.col("low")).drop("top", "low")


def dbh_from_cylinders(cylinders: DataFrame) -> DataFrame:
    """(tree_id, dbh_qsm): the diameter of the first trunk cylinder at whose end the trunk is at least 1.3 m long, else of the last."""
    w = Window.partitionBy("tree_id").orderBy("position")  # a trunk's cylinders
    run = cylinders.filter("branch = 1").withColumn("run", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("tree_id").agg((2 * F.coalesce(F.min_by("radius", F.when(F.col("run") >= 1.3, F.col("position"))), F.max_by("radius", "position"))).alias("dbh_qsm"))


def location(cylinders: DataFrame) -> DataFrame:
    """(tree_id, x, y, z): the start of the first cylinder."""
    return cylinders.groupBy("tree_id").agg(F.min_by(F.struct(*(F.col(f"start_{c}").alias(c) for c in "xyz")), "cyl_id").alias("s")).select("tree_id", "s.*")


def stem_taper(cylinders: DataFrame) -> DataFrame:
    """(tree_id, step, distance, diameter) along the trunk: a point at each cylinder's start, and one at the last one's end."""
    trunk = cylinders.filter("branch = 1")
    w = Window.partitionBy("tree_id").orderBy("position")
    run = trunk.select(
        "tree_id",
        F.row_number().over(w).cast("long").alias("step"),
        (F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("distance"),
        (2 * F.col("radius")).alias("diameter"),
    )
    end = trunk.groupBy("tree_id").agg((F.count("*") + 1).alias("step"), F.sum("length").alias("distance"), (2 * F.max_by("radius", "position")).alias("diameter"))
    return run.unionByName(end)


def model_points(cylinders: DataFrame) -> DataFrame:
    """(tree_id, cyl_id, x, y, z) on the model's surface: 4 rings of 12 points on the trunk's cylinders, one of 4 at the end
    of others, and all starts and ends; equal points once, as those of the smallest cylinder."""
    axis, start = vec("axis"), vec("start")
    first, _ = basis(axis)
    trunk = F.col("branch") == 1
    rings, sides = F.when(trunk, 4).otherwise(1), F.when(trunk, 12).otherwise(4)
    c = cylinders.withColumns({"rings": rings, "sides": sides}).withColumn("ring", F.explode(F.expr("sequence(1, rings)"))).withColumn("side", F.explode(F.expr("sequence(0, sides - 1)")))
    at = start + axis.scale(F.col("length") * F.col("ring") / F.col("rings")) + rotate(first, axis, 2 * F.pi() * F.col("side") / F.col("sides")).scale(F.col("radius"))
    named = lambda v: [a.alias(n) for a, n in zip(v, "xyz", strict=True)]
    surface = c.select("tree_id", "cyl_id", *named(at))
    ends = cylinders.select("tree_id", "cyl_id", *named(start)).union(cylinders.select("tree_id", "cyl_id", *named(start + axis.scale(F.col("length")))))
    return surface.union(ends).groupBy("tree_id", "x", "y", "z").agg(F.min("cyl_id").alias("cyl_id")).select("tree_id", "cyl_id", "x", "y", "z")


def with_layers(points: DataFrame) -> DataFrame:
    """points with m, the number of layers of the tree (20 if it is over 10 m high, 10 if over 2 m, else 5) and their layer, 1 to m."""
    d = with_per_tree(points, F.min("z").alias("low"), F.max("z").alias("high"))
    h = F.col("high") - F.col("low")
    d = d.withColumn("m", F.when(h > 10, 20).when(h > 2, 10).otherwise(5).cast("long"))
    return d.withColumn("layer", F.least(F.col("m"), F.floor(F.coalesce(F.try_divide(F.col("z") - F.col("low"), h), F.lit(0.0)) * F.col("m")) + 1).cast("long")).drop("low", "high")


def spreads(points: DataFrame, centre: DataFrame) -> DataFrame:
    """(tree_id, layer, direction, spread): 18 directions of 10 degrees; the largest distance from the tree's centre (tree_id,
    c_x, c_y) in the sector and in the opposite one, added; 0 without points."""
    d = with_layers(points).join(centre, "tree_id")
    dx, dy = F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y")
    sector = F.least(F.lit(35), F.floor(F.round((F.degrees(F.atan2(dy, dx)) + 180) / 10, 9))).cast("long")
    far = d.select("tree_id", "m", "layer", sector.alias("sector"), F.sqrt(dx * dx + dy * dy).alias("r")).groupBy("tree_id", "m", "layer", "sector").agg(F.max("r").alias("r"))
    each = far.groupBy("tree_id", "layer", (F.col("sector") % 18 + 1).alias("direction")).agg(F.sum("r").alias("spread"))
    all_ = far.select("tree_id", "m").distinct().withColumn("layer", F.explode(F.expr("sequence(1L, m)"))).withColumn("direction", F.explode(F.sequence(F.lit(1), F.lit(18)).cast("array<bigint>")))
    return all_.join(each, ["tree_id", "layer", "direction"], "left").select("tree_id", "layer", "direction", F.coalesce("spread", F.lit(0.0)).alias("spread"))


def centroids(points: DataFrame) -> DataFrame:
    return points.groupBy("tree_id").agg(F.avg("x").alias("c_x"), F.avg("y").alias("c_y"))


def vertical_profile(s: DataFrame) -> DataFrame:
    """(tree_id, layer, mean_spread) of spreads."""
    return s.groupBy("tree_id", "layer").agg(F.avg("spread").alias("mean_spread"))


def crown_diameters(points: DataFrame, centre: DataFrame) -> DataFrame:
    """(tree_id, crown_diam_ave): the mean over 18 directions of the tree's spread, all layers together."""
    d = points.join(centre, "tree_id")
    dx, dy = F.col("x") - F.col("c_x"), F.col("y") - F.col("c_y")
    sector = F.least(F.lit(35), F.floor(F.round((F.degrees(F.atan2(dy, dx)) + 180) / 10, 9))).cast("long")
    far = d.groupBy("tree_id", sector.alias("sector")).agg(F.max(F.sqrt(dx * dx + dy * dy)).alias("r"))
    return far.groupBy("tree_id").agg((F.sum("r") / 18).alias("crown_diam_ave"))


def crown_base(branches: DataFrame, cylinders: DataFrame, tree: DataFrame) -> DataFrame:
    """(tree_id, crown_base_height, crown_length, crown_ratio).

    Of the first-order branches by height, from the second on, the crown starts at the first whose diameter is over the
    smaller of 5 cm and 5 % of the trunk's and whose reach (from its start to its last end, along the ground) is over the
    smaller of 10 m and the median reach of all branches, those of other orders counted as 0. The base is the lowest start
    of it and of all that hangs on it; without such a branch, the tree's height.

    branches: (tree_id, branch, order, diameter, height, parent); tree: (tree_id, tree_height, dbh_qsm).
    """
    end = vec("start") + vec("axis").scale(F.col("length"))
    c = cylinders.withColumns({f"end_{n}": e for n, e in zip("xyz", end, strict=True)})
    ends = c.groupBy("tree_id", "branch").agg(F.min_by(F.struct("start_x", "start_y"), "position").alias("s"), F.max_by(F.struct("end_x", "end_y"), "position").alias("e"), F.min("start_z").alias("low"))
    reach = F.hypot(F.col("e.end_x") - F.col("s.start_x"), F.col("e.end_y") - F.col("s.start_y"))
    b = branches.join(ends, ["tree_id", "branch"]).withColumn("reach", F.when(F.col("order") == 1, reach).otherwise(0.0)).select("tree_id", "branch", "order", "diameter", "height", "parent", "reach", "low")
    median = b.groupBy("tree_id").agg(F.median("reach").alias("median_reach"))
    w = Window.partitionBy("tree_id").orderBy("height", "branch")
    ranked = b.filter("order = 1").withColumn("rank", F.row_number().over(w)).join(median, "tree_id").join(tree, "tree_id")
    fit = ranked.filter((F.col("rank") > 1) & (F.col("diameter") > F.least(F.lit(0.05), 0.05 * F.col("dbh_qsm"))) & (F.col("reach") > F.least(F.lit(10.0), F.col("median_reach"))))
    start = fit.groupBy("tree_id").agg(F.min_by("branch", "rank").alias("root"))
    from .graph import descendants

    below = descendants(b.select("tree_id", F.col("branch").alias("node"), "parent"), start.select("tree_id", F.col("root").alias("node")))
    lowest = below.join(b.select("tree_id", F.col("branch").alias("node"), "low"), ["tree_id", "node"]).groupBy("tree_id").agg(F.min("low").alias("low"))
    base = cylinders.groupBy("tree_id").agg(F.min_by("start_z", "cyl_id").alias("ground"))
    t = tree.join(base, "tree_id").join(lowest, "tree_id", "left").withColumn("crown_base_height", F.coalesce(F.col("low") - F.col("ground"), F.col("tree_height")))
    crown = F.col("tree_height") - F.col("crown_base_height")
    return t.select("tree_id", "crown_base_height", crown.alias("crown_length"), F.try_divide(crown, F.col("tree_height")).alias("crown_ratio"))


def with_units(attributes: DataFrame) -> DataFrame:
    """(name, value, unit) rows of attributes(name, value): the unit by the words of the name."""
    unit = F.lit("")
    for word, u in UNITS.items():
        unit = F.when(F.col("name").contains(word), F.lit(u)).otherwise(unit)
    return attributes.withColumn("unit", unit)
