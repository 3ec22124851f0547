"""Parameters of reconstructions: defaults, sweeps, and values derived from the clouds."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import with_per_tree


@dataclass(frozen=True)
class Filter:
    k: int = 10
    radius: float = 0.0
    nsigma: float = 1.5
    patch_diam1: float = 0.05
    ball_rad1: float = 0.075
    ncomp: int = 2
    edge_length: float = 0.004


@dataclass(frozen=True)
class Params:
    """Defaults are fixed values. The five lengths of patches and balls are lists: a sweep takes patch_diam1 with ball_rad1 and
    patch_diam2_max with ball_rad2 in pairs, and all combinations of the pairs with patch_diam2_min."""

    patch_diam1: tuple[float, ...] = (0.08, 0.12)
    patch_diam2_min: tuple[float, ...] = (0.02, 0.03)
    patch_diam2_max: tuple[float, ...] = (0.07, 0.10)
    ball_rad1: tuple[float, ...] = (0.095, 0.135)
    ball_rad2: tuple[float, ...] = (0.08, 0.11)
    nmin1: int = 3
    nmin2: int = 1
    only_tree: bool = True
    tria: bool = False
    dist: bool = True
    min_cyl_rad: float = 0.0025
    parent_cor: bool = True
    taper_cor: bool = True
    growth_vol_cor: bool = False
    growth_vol_fac: float = 1.5
    name: str = "tree"
    tree: int = 1
    model: int = 1
    filter: Filter = field(default_factory=Filter)

    def sweep(self) -> list[Params]:
        """One Params of single lengths for each combination."""
        pairs = product(zip(self.patch_diam1, self.ball_rad1, strict=True), zip(self.patch_diam2_max, self.ball_rad2, strict=True), self.patch_diam2_min)
        return [replace(self, patch_diam1=(a,), ball_rad1=(b,), patch_diam2_max=(c,), ball_rad2=(d,), patch_diam2_min=(e,)) for (a, b), (c, d), e in pairs]

    def suffix(self) -> str:
        """What a file name says of a combination: only of lengths that have several values."""
        parts = (("_D", self.patch_diam1), ("_DA", self.patch_diam2_max), ("_DI", self.patch_diam2_min))
        return "".join(f"{n}{v[0]:g}" for n, v in parts if len(v) > 1)


def sweep_table(spark: SparkSession, params: Params) -> DataFrame:
    """(combination, pd1, br1, pd2max, br2, pd2min): the sweep as a table, exploded from the lists."""
    p = asdict(params)
    d = spark.createDataFrame([tuple(list(p[k]) for k in ("patch_diam1", "ball_rad1", "patch_diam2_max", "ball_rad2", "patch_diam2_min"))], "pd1 array<double>, br1 array<double>, pd2max array<double>, br2 array<double>, pd2min array<double>")
    d = d.select(F.posexplode(F.arrays_zip("pd1", "br1")).alias("h", "a"), "pd2max", "br2", "pd2min").select("h", "a.*", F.posexplode(F.arrays_zip("pd2max", "br2")).alias("i", "b"), "pd2min")
    d = d.select("h", "i", "pd1", "br1", "b.*", F.posexplode("pd2min").alias("j", "pd2min"))
    n, m = len(params.patch_diam2_max), len(params.patch_diam2_min)
    return d.select(((F.col("h") * n + F.col("i")) * m + F.col("j") + 1).cast("long").alias("combination"), "pd1", "br1", "pd2max", "br2", "pd2min")


def suffix_table(spark: SparkSession, params: Params) -> DataFrame:
    """(combination, suffix): what the file names of a sweep's models say, of the lengths that have several values only."""
    parts = (("_D", "pd1", params.patch_diam1), ("_DA", "pd2max", params.patch_diam2_max), ("_DI", "pd2min", params.patch_diam2_min))
    said = [F.concat(F.lit(n), F.col(c).cast("string")) for n, c, values in parts if len(values) > 1]
    return sweep_table(spark, params).select("combination", F.concat(*said, F.lit("")).alias("suffix"))


def defaults_table(spark: SparkSession, params: Params | None = None) -> DataFrame:
    """(name, place, value): every parameter, lists by place, flags as 0 and 1, and the filter's with a dot."""
    rows = []
    flat = asdict(params or Params())
    flat |= {f"filter.{k}": v for k, v in flat.pop("filter").items()}
    for name, value in flat.items():
        for i, v in enumerate(value if isinstance(value, (list, tuple)) else [value]):
            if not isinstance(v, str):
                rows.append((name, i + 1, float(v)))
    return spark.createDataFrame(rows, "name string, place int, value double")


def sequence(value: float, n: int) -> tuple[float, ...]:
    """n values round one, 10 % to either side for two and 10 % more for each further one."""
    if n <= 1:
        return (value,)
    spread = 0.1 + (n - 2) * 0.1
    return tuple(np.linspace((1 - spread) * value, (1 + spread) * value, n).tolist())


def derive(points: DataFrame, n1: int = 2, n2min: int = 2, n2max: int = 2) -> DataFrame:
    """(tree_id, height, stem_radius, resolution, pd1, pd2min, pd2max, br1, br2 as arrays) from each tree's lower stem.

    The stem is the slice between 2 % of the height and the smaller of 4 m and 10 %. Its axis is the main direction of unit
    vectors from the slice's mean, its radius the median distance from it; the resolution is the root of the stem's surface
    there per point. Sums over all points find slices; only slices come to one task a tree.
    """
    d = with_per_tree(points, F.min("z").alias("low"), (F.max("z") - F.min("z")).alias("height"))
    z = F.col("z") - F.col("low")
    top = F.least(F.lit(4.0), 0.1 * F.col("height"))
    slice_ = d.filter((z > 0.02 * F.col("height")) & (z < top)).select("tree_id", "x", "y", "z", "height")
    schema = "tree_id long, height double, stem_radius double, resolution double, pd1 array<double>, pd2min array<double>, pd2max array<double>, br1 array<double>, br2 array<double>"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..functions.fitting import along, main_direction

        p, h = pdf[["x", "y", "z"]].to_numpy(), float(pdf["height"].iloc[0])
        v = p - p.mean(0)
        n = np.linalg.norm(v, axis=1)
        axis = main_direction(v[n > 0] / n[n > 0, None]) if (n > 0).any() else np.array([0.0, 0.0, 1.0])
        r = float(np.median(along(p, axis, p.mean(0))[0]))
        section = min(4.0, 0.1 * h) - 0.02 * h
        res = float(np.sqrt(2 * np.pi * max(r, 1e-6) * max(section, 1e-6) / len(p)))
        a, lo, hi = sequence(r / 3, n1), sequence(r / 6 * min(1.0, 20 / max(h, 1e-6)), n2min), sequence(r / 2.5, n2max)
        b1 = [max(x + 1.5 * res, min(1.25 * x, x + 0.025)) for x in a]
        b2 = [max(x + 1.25 * res, min(1.2 * x, x + 0.025)) for x in hi]
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "height": [h], "stem_radius": [r], "resolution": [res], "pd1": [list(a)], "pd2min": [list(lo)], "pd2max": [list(hi)], "br1": [b1], "br2": [b2]})

    return slice_.groupBy("tree_id").applyInPandas(one, schema)
