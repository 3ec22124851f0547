"""Surface coverage of cylinders by points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import basis, vec

TURNS = 4


def unrolled(points: DataFrame) -> DataFrame:
    """points with (h, d, angle): height along the axis (axis_*) from its start (start_*), distance to it, and angle round it,
    0 to 2 pi, from a direction that depends on the axis only."""
    at, axis, start = vec(""), vec("axis"), vec("start")
    h = (at - start).dot(axis)
    out = (at - start) - axis.scale(h)
    u, v = basis(axis)
    turn = F.atan2(out.dot(v), out.dot(u))
    return points.withColumns({"h": h, "d": out.norm(), "angle": F.when(turn < 0, turn + 2 * F.pi()).otherwise(turn)})


def cells(points: DataFrame, keys: list[str], layers: int, sectors: int, turns: int = TURNS) -> DataFrame:
    """Unrolled points in their (turn, layer, sector): for each of some baselines, a part of a sector apart. `length` is the
    cylinder's; points off its ends lie in its outer layers."""
    layer = F.least(F.lit(layers - 1), F.greatest(F.lit(0), F.floor(F.round(F.col("h") / F.col("length") * layers, 9)))).cast("long")
    width = 2 * F.pi() / sectors
    d = points.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    sector = F.pmod(F.floor(F.round((F.col("angle") + F.col("turn") * width / turns) / width, 9)), F.lit(sectors)).cast("long")
    return d.withColumns({"layer": layer, "sector": sector})


def surface_coverage(points: DataFrame, keys: list[str], layers: int, sectors: int, turns: int = TURNS, least: float | None = None, most: float | None = None) -> DataFrame:
    """(keys, coverage): the share of layer and sector cells that points hit, for the baseline that gives the most.

    points: (keys, x, y, z, start_*, axis_*, length). Only points at distances above `least` and below `most` count. One
    baseline is the simple variant.
    """
    d = unrolled(points)
    if least is not None:
        d = d.filter(F.col("d") > least)
    if most is not None:
        d = d.filter(F.col("d") < most)
    hit = cells(d, keys, layers, sectors, turns).groupBy(*keys, "turn").agg(F.count_distinct("layer", "sector").alias("n"))
    return hit.groupBy(*keys).agg((F.max("n") / (layers * sectors)).alias("coverage"))


def cell_distances(points: DataFrame, keys: list[str], layers: int, sectors: int) -> DataFrame:
    """(keys, layer, sector, distance): the mean distance of each cell that is hit, on the first baseline."""
    return cells(unrolled(points), keys, layers, sectors, 1).groupBy(*keys, "layer", "sector").agg(F.avg("d").alias("distance"))


def volume_of_cells(distances: DataFrame, keys: list[str], layers: int, sectors: int, length: Column) -> DataFrame:
    """(keys, volume) in litres of the body that the cells' distances span; cells that aren't hit take the mean of the others."""
    d = distances.groupBy(*keys).agg(F.sum(F.col("distance") * F.col("distance")).alias("s"), F.avg("distance").alias("m"), F.count("*").alias("n"), F.first(length).alias("length"))
    total = F.col("s") + (layers * sectors - F.col("n")) * F.col("m") * F.col("m")
    return d.select(*keys, (1000 * F.pi() * F.col("length") * total / (layers * sectors)).alias("volume"))


def coverage_filter(points: DataFrame, keys: list[str], layer_height: float, sectors: int) -> tuple[DataFrame, DataFrame]:
    """Points near the surface, and (keys, radius, coverage, mad) of what is left.

    In each cell, points no farther out than the nearest one and max(1 cm, 5 % of the radius) stay. The new radius is the
    median over cells of min(1.05 D, D + 2 cm) of the nearest distance D. Cells are found by windows over cells, never over
    a whole cylinder. points: (keys, x, y, z, start_*, axis_*, length, radius).
    """
    d = unrolled(points)
    layer = F.floor(F.round(F.col("h") / layer_height, 9)).cast("long")
    sector = F.pmod(F.floor(F.round(F.col("angle") / (2 * F.pi() / sectors), 9)), F.lit(sectors)).cast("long")
    d = d.withColumns({"layer": layer, "sector": sector})
    w = Window.partitionBy(*keys, "layer", "sector")
    kept = d.withColumn("near", F.min("d").over(w)).filter(F.col("d") <= F.col("near") + F.greatest(F.lit(0.01), 0.05 * F.col("radius")))
    per = kept.groupBy(*keys, "layer", "sector").agg(F.first("near").alias("near"), F.first("length").alias("length"))
    n = F.greatest(F.lit(1.0), F.ceil(F.round(F.first("length") / layer_height, 9)).cast("double")) * sectors
    radius = per.groupBy(*keys).agg(F.median(F.least(1.05 * F.col("near"), F.col("near") + 0.02)).alias("new_radius"), F.least(F.lit(1.0), F.count("*") / n).alias("coverage"))
    fit = kept.join(radius, keys).groupBy(*keys).agg(F.first("new_radius").alias("radius"), F.first("coverage").alias("coverage"), F.avg(F.abs(F.col("d") - F.col("new_radius"))).alias("mad"))
    return kept.select(*points.columns), fit


def moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, six covariances) of x, y, z: partial sums, from which dimensions and main directions follow."""
    pairs = [("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z")]
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *(F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in pairs))
