"""Distributions of volume, area, length and number over classes, dense: classes without members are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import clamp

#: Decimals that a value is rounded to before it is classed, so that values on an edge fall the same way everywhere.
PLACES = 9


def classed(value: Column, width: float) -> Column:
    """1-based class of half-open classes of a width."""
    return (F.floor(F.round(value / width, PLACES)) + 1).cast("long")


def dense(per: DataFrame, sizes: DataFrame, values: list[str]) -> DataFrame:
    """per (tree_id, class, values) with a row for each class from 1 to the tree's n of sizes (tree_id, n)."""
    frame = sizes.withColumn("class", F.explode(F.expr("sequence(1L, n)"))).select("tree_id", "class")
    return frame.join(per, ["tree_id", "class"], "left").select("tree_id", "class", *(F.coalesce(v, F.lit(0.0) if v != "number" else F.lit(0)).alias(v) for v in values))


def measures() -> list[Column]:
    l, r = F.col("length"), F.col("radius")
    return [(1000 * F.pi() * F.sum(l * r * r)).alias("volume"), (2 * F.pi() * F.sum(l * r)).alias("area"), F.sum("length").alias("length")]


def cylinder_distribution(cylinders: DataFrame, by: str) -> DataFrame:
    """(tree_id, class, volume, area, length): by dia, 1 cm of diameter (as many classes as the tree needs); by zen, 18 of
    10 degrees from the vertical; by azi, 36 of 10 degrees from -180. Values on the uppermost edge are in no class."""
    value, width, n = {
        "dia": (F.col("radius"), 0.005, None),
        "zen": (F.degrees(F.acos(clamp(F.col("axis_z")))), 10.0, 18),
        "azi": (F.degrees(F.atan2("axis_y", "axis_x")) + 180, 10.0, 36),
    }[by]
    c = cylinders.withColumn("class", classed(value, width))
    per = c.groupBy("tree_id", "class").agg(*measures())
    sizes = per.groupBy("tree_id").agg(F.max("class").alias("n")) if n is None else per.select("tree_id").distinct().withColumn("n", F.lit(n).cast("long"))
    return dense(per, sizes, ["volume", "area", "length"])


def cylinder_height_distribution(cylinders: DataFrame, compat: bool = False) -> DataFrame:
    """(tree_id, class, volume, area, length) in 1 m classes over the tree's lowest start.

    A cylinder is shared among the classes that its axis runs through, in proportion to its height in each; a level one
    lies in one class. With `compat`, cylinders that run through more than two classes count nowhere.
    """
    from .spatial import with_per_tree

    low, high = F.least("start_z", "end_z"), F.greatest("start_z", "end_z")
    c = cylinders.withColumn("end_z", F.col("start_z") + F.col("length") * F.col("axis_z"))
    c = with_per_tree(c.withColumns({"low": low, "high": high}), F.min(low).alias("base"))
    c = c.withColumns({"low": F.col("low") - F.col("base"), "high": F.col("high") - F.col("base")})
    c = c.withColumns({"first": F.floor(F.round("low", PLACES)).cast("long"), "last": F.floor(F.round("high", PLACES)).cast("long")})
    if compat:
        c = c.filter(F.col("last") - F.col("first") <= 1)
    c = c.withColumn("at", F.explode(F.expr("sequence(first, last)")))
    inside = F.least(F.col("high"), F.col("at") + 1) - F.greatest(F.col("low"), F.col("at").cast("double"))
    weight = F.when(F.col("first") == F.col("last"), 1.0).otherwise(F.greatest(F.lit(0.0), F.try_divide(inside, F.col("high") - F.col("low"))))
    per = c.withColumn("length", F.col("length") * weight).groupBy("tree_id", (F.col("at") + 1).alias("class")).agg(*measures())
    return dense(per, per.groupBy("tree_id").agg(F.max("class").alias("n")), ["volume", "area", "length"])


def branch_distribution(branches: DataFrame, by: str, compat: bool = False) -> DataFrame:
    """(tree_id, class, volume, area, length, number, and the same of first-order branches as volume1 ...), the trunk left out.

    By dia, 1 cm classes (0.5 cm with `compat`), hei, 1 m, ang, 18 of 10 degrees, azi, 36 from -180, zen, 18 of 10 degrees.
    """
    value, width, n = {
        "dia": (F.col("diameter"), 0.005 if compat else 0.01, None),
        "hei": (F.col("height"), 1.0, None),
        "ang": (F.col("angle"), 10.0, 18),
        "azi": (F.col("azimuth") + 180, 10.0, 36),
        "zen": (F.col("zenith"), 10.0, 18),
    }[by]
    b = branches.filter("order > 0").withColumn("class", classed(value, width)).filter("class >= 1")
    first = F.col("order") == 1
    values = ["volume", "area", "length"]
    per = b.groupBy("tree_id", "class").agg(
        *(F.sum(v).alias(v) for v in values),
        F.count("*").alias("number"),
        *(F.sum(F.when(first, F.col(v)).otherwise(0.0)).alias(f"{v}1") for v in values),
        F.count(F.when(first, 1)).alias("number1"),
    )
    sizes = per.groupBy("tree_id").agg(F.max("class").alias("n")) if n is None else per.select("tree_id").distinct().withColumn("n", F.lit(n).cast("long"))
    d = dense(per, sizes, [*values, "number", *(f"{v}1" for v in values), "number1"])
    return d.withColumns({c: F.col(c).cast("long") for c in ("number", "number1")})


def branch_order_distribution(branches: DataFrame) -> DataFrame:
    """(tree_id, class, volume, area, length, number) by branch order from 1 on."""
    return branches.filter("order > 0").groupBy("tree_id", F.col("order").alias("class")).agg(*(F.sum(v).alias(v) for v in ("volume", "area", "length")), F.count("*").alias("number"))
