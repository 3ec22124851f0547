"""Editing cylinder models: truncation by order, removal of thin branches, merging of cylinders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Vec, vec
from ..plans.lineage import cut
from .graph import descendants


def renumber(cylinders: DataFrame) -> DataFrame:
    """cylinders with cyl_id 1, 2, ... by tree in the old order; parents and extensions that are gone become null."""
    w = Window.partitionBy("tree_id").orderBy("cyl_id")
    c = cylinders.withColumn("new_id", F.row_number().over(w).cast("long"))
    ids = c.select("tree_id", "cyl_id", "new_id")
    for name in ("parent", "extension"):
        c = c.join(ids.select("tree_id", F.col("cyl_id").alias(name), F.col("new_id").alias(f"new_{name}")), ["tree_id", name], "left").drop(name).withColumnRenamed(f"new_{name}", name)
    return c.drop("cyl_id").withColumnRenamed("new_id", "cyl_id").select(*cylinders.columns)


def truncate_order(cylinders: DataFrame, most: int) -> DataFrame:
    """The cylinders of branches up to an order."""
    return renumber(cylinders.filter(F.col("branch_order") <= most))


def drop_thin(cylinders: DataFrame, least: float) -> DataFrame:
    """Without branches whose diameter, that of their first cylinder, is below `least`, and without all that hangs on them;
    the trunk stays."""
    owner = cylinders.select("tree_id", F.col("cyl_id").alias("parent"), F.col("branch").alias("p_branch"))
    per = cylinders.groupBy("tree_id", "branch").agg(F.min_by(F.struct("radius", "parent"), "position").alias("f")).select("tree_id", "branch", "f.*")
    tree = cut(per.join(owner, ["tree_id", "parent"], "left").select("tree_id", F.col("branch").alias("node"), F.col("p_branch").alias("parent"), "radius"))
    thin = tree.filter((2 * F.col("radius") < least) & F.col("parent").isNotNull()).select("tree_id", "node")
    gone = descendants(tree.select("tree_id", "node", "parent"), thin).withColumnRenamed("node", "branch")
    return renumber(cylinders.join(gone, ["tree_id", "branch"], "left_anti"))


def merge_pairs(cylinders: DataFrame) -> DataFrame:
    """(tree_id, branch, position, radius, length, start_*, axis_*, members): each branch's cylinders merged two by two.

    An even number pairs from the first on; of an odd number the first stays alone. A merged cylinder runs from the start
    of its first to the end of its last member and keeps their volume.
    """
    n = F.count("*").over(Window.partitionBy("tree_id", "branch"))
    group = F.when(F.col("n") % 2 == 0, F.floor((F.col("position") - 1) / 2)).otherwise(F.floor(F.col("position") / 2)) + 1
    c = cylinders.withColumn("n", n).withColumn("pair", group.cast("long"))
    end = vec("start") + vec("axis").scale(F.col("length"))
    c = c.withColumns({f"end_{a}": e for a, e in zip("xyz", end, strict=True)})
    g = c.groupBy("tree_id", "branch", "pair").agg(
        F.min_by(F.struct(*(f"start_{a}" for a in "xyz")), "position").alias("s"),
        F.max_by(F.struct(*(f"end_{a}" for a in "xyz")), "position").alias("e"),
        F.sum(F.col("length") * F.col("radius") * F.col("radius")).alias("v"),
        F.count("*").alias("members"),
        F.min_by("radius", "position").alias("r1"),
        F.min_by("length", "position").alias("l1"),
        F.min_by(F.struct(*(f"axis_{a}" for a in "xyz")), "position").alias("a1"),
    )
    start, stop = Vec(*(F.col(f"s.start_{a}") for a in "xyz")), Vec(*(F.col(f"e.end_{a}") for a in "xyz"))
    way = stop - start
    length = way.norm()
    alone = F.col("members") == 1
    axis = way.unit()
    return g.select(
        "tree_id",
        "branch",
        F.col("pair").alias("position"),
        F.when(alone, F.col("r1")).otherwise(F.sqrt(F.try_divide(F.col("v"), length))).alias("radius"),
        F.when(alone, F.col("l1")).otherwise(length).alias("length"),
        *(F.col(f"s.start_{a}").alias(f"start_{a}") for a in "xyz"),
        *(F.when(alone, F.col(f"a1.axis_{a}")).otherwise(x).alias(f"axis_{a}") for a, x in zip("xyz", axis, strict=True)),
        "members",
    )


def reattach(cylinders: DataFrame) -> DataFrame:
    """(tree_id, cyl_id, start_*, length, axis_*): first cylinders of branches moved to start on the surface of their parent,
    towards where they started, with their end in place; others as they are. Starts on the parent's axis stay."""
    p = cylinders.select("tree_id", F.col("cyl_id").alias("parent"), *(F.col(f"start_{a}").alias(f"ps_{a}") for a in "xyz"), *(F.col(f"axis_{a}").alias(f"pa_{a}") for a in "xyz"), F.col("radius").alias("p_radius"))
    c = cylinders.join(p, ["tree_id", "parent"], "left")
    start, end = vec("start"), vec("start") + vec("axis").scale(F.col("length"))
    ps, pa = vec("ps"), vec("pa")
    h = (start - ps).dot(pa)
    foot = ps + pa.scale(h)
    out = start - foot
    d = out.norm()
    new = foot + out.scale(F.try_divide(F.col("p_radius"), d))
    move = (F.col("position") == 1) & F.col("ps_x").isNotNull() & (d > 0)
    way = end - new
    moved = [F.when(move, n).otherwise(s).alias(f"start_{a}") for a, n, s in zip("xyz", new, start, strict=True)]
    axes = [F.when(move, n).otherwise(s).alias(f"axis_{a}") for a, n, s in zip("xyz", way.unit(), vec("axis"), strict=True)]
    return c.select("tree_id", "cyl_id", *moved, F.when(move, way.norm()).otherwise(F.col("length")).alias("length"), *axes)


def simplify(cylinders: DataFrame, most_order: int, least_diameter: float, merges: int = 0) -> DataFrame:
    """Order truncation, then thin-branch removal, then pairs of cylinders merged as often as asked."""
    out = drop_thin(truncate_order(cylinders, most_order), least_diameter)
    for _ in range(merges):
        out = cut(merge_pairs(out))
    return out


def refresh(cylinders: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(branch, attributes) of simplified cylinders; the breast height diameters, which were measured on the whole model, stay
    those of the attributes before."""
    from . import attributes, branches

    kept = [c for c in ("dbh_qsm", "dbh_cyl", "dbh_tri") if c in before.columns]
    new = attributes.totals(cylinders).join(before.select(F.col("tree_id").alias("b_tree"), *kept), F.col("tree_id") == F.col("b_tree"), "left").drop("b_tree")
    return branches.full_branch_table(cylinders), new
