"""Closed curves as tables (tree_id, k, x, y): vertex k = 1, 2, ... of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def elements(curve: DataFrame) -> DataFrame:
    """(tree_id, n, k, x, y, dx, dy): each vertex and the way to the next, the last one's to the first."""
    w = Window.partitionBy("tree_id").orderBy("k")
    first = curve.groupBy("tree_id").agg(F.min_by(F.struct("x", "y"), "k").alias("f"), F.count("*").alias("n"))
    d = curve.join(first, "tree_id").withColumns({"nx": F.coalesce(F.lead("x").over(w), F.col("f.x")), "ny": F.coalesce(F.lead("y").over(w), F.col("f.y"))})
    return d.select("tree_id", "n", "k", "x", "y", (F.col("nx") - F.col("x")).alias("dx"), (F.col("ny") - F.col("y")).alias("dy"))


def self_intersections(curve: DataFrame) -> DataFrame:
    """(tree_id, i, j, s, t): elements i < j that aren't neighbours and cross, at shares s and t of their lengths; the 2 x 2
    system of each pair of one curve is solved in closed form."""
    e = elements(curve)
    a, b = e.alias("a"), e.alias("b")
    apart = (F.col("a.tree_id") == F.col("b.tree_id")) & (F.col("b.k") > F.col("a.k") + 1) & ~((F.col("a.k") == 1) & (F.col("b.k") == F.col("a.n")))
    det = F.col("a.dx") * F.col("b.dy") - F.col("a.dy") * F.col("b.dx")
    wx, wy = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")
    s = F.try_divide(wx * F.col("b.dy") - wy * F.col("b.dx"), det)
    t = F.try_divide(wx * F.col("a.dy") - wy * F.col("a.dx"), det)
    found = a.join(b, apart).select("a.tree_id", F.col("a.k").alias("i"), F.col("b.k").alias("j"), s.alias("s"), t.alias("t"))
    return found.filter("s > 0 and s < 1 and t > 0 and t < 1")


def area(curve: DataFrame) -> DataFrame:
    """(tree_id, area) by the shoelace formula."""
    e = elements(curve)
    return e.groupBy("tree_id").agg((F.abs(F.sum(F.col("x") * (F.col("y") + F.col("dy")) - (F.col("x") + F.col("dx")) * F.col("y"))) / 2).alias("area"))


def mesh_volume(facets: DataFrame) -> DataFrame:
    """(tree_id, volume, area) of closed meshes (tree_id, x1 .. z3), in litres and m2, by the divergence theorem."""
    c = {f"{a}{i}": F.col(f"{a}{i}") for a in "xyz" for i in (1, 2, 3)}
    ux, uy, uz = (c[f"{a}2"] - c[f"{a}1"] for a in "xyz")
    vx, vy, vz = (c[f"{a}3"] - c[f"{a}1"] for a in "xyz")
    nx, ny, nz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    return facets.groupBy("tree_id").agg((1000 * F.abs(F.sum(c["x1"] * nx + c["y1"] * ny + c["z1"] * nz)) / 6).alias("volume"), (F.sum(F.sqrt(nx * nx + ny * ny + nz * nz)) / 2).alias("area"))
