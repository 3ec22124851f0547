"""Grids and spatial joins: every distance join is lowered to an equi-join on cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import neighbours
from ..plans.lineage import broadcast_below, cut

#: Tables of one row a tree are broadcast up to this many trees.
BROADCAST_TREES = 200_000
#: Rows of points that still look for neighbours, spread to their cells, that are broadcast to all points.
BROADCAST_OPEN = 400_000
AXES = ("x", "y", "z")
#: Points of a tree that a task can hold in arrays; trees of more are joined by cells, dealt to all tasks.
TREE_POINTS = 200_000
#: Points that a kernel gets at once, if trees are smaller.
ARRAY_POINTS = 50_000


def parted(points: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Points of trees of at most TREE_POINTS, and those of the others, None if there are none."""
    large = points.groupBy(F.col("tree_id").alias("_tree")).agg(F.count("*").alias("_n")).filter(F.col("_n") > (TREE_POINTS if most is None else most)).select("_tree")
    if not large.limit(1).count():
        return points, None
    large = broadcast_below(cut(large), BROADCAST_TREES)
    same = F.col("tree_id") == F.col("_tree")
    return points.join(large, same, "left_anti"), points.join(large, same, "left_semi")


def by_tree(points: DataFrame, run: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str, most: int = ARRAY_POINTS) -> DataFrame:
    """run(rows, tree codes, coordinates) of whole trees, many at once. Trees are dealt out once (not again where their points
    lie by tree already) and only then looked through, so no row is copied to a neighbouring cell's task. most: points that run gets
    at once, if trees are smaller.

    Points of null trees or without valid coordinates have no neighbours and are left out.
    """
    valid = F.col("tree_id").isNotNull()
    for a in AXES:
        valid = valid & F.col(a).isNotNull() & ~F.isnan(a)
    dealt = points.repartition("tree_id").sortWithinPartitions("tree_id").filter(valid)

    def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
        tree = t.column("tree_id").to_numpy()
        code = np.cumsum(np.r_[0, tree[1:] != tree[:-1]])
        yield from run(t, code, np.column_stack([t.column(a).to_numpy() for a in AXES])).to_batches(10_000)

    def stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in it:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= most:
                t = pa.Table.from_batches(held).combine_chunks()
                last = pc.index(t.column("tree_id"), t.column("tree_id")[-1]).as_py()
                if last:
                    yield from whole(t.slice(0, last))
                held, n = t.slice(last).to_batches(), t.num_rows - last
        if n:
            yield from whole(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(stream, schema)


def ids_of(t: pa.Table, names: tuple[str, ...] = ("tree_id", "point_id")) -> dict[str, pa.ChunkedArray]:
    return {n: t.column(n) for n in names}


def count_near(points: DataFrame, radius2: str, largest: float) -> DataFrame:
    """(tree_id, point_id, n, ids): how many points of the tree have a squared distance below radius2, an expression of columns,
    itself counted, and the sum of their ids. largest: no radius is above it."""
    points, large = parted(points.select("tree_id", "point_id", *AXES, F.expr(radius2).cast("double").alias("radius2")))

    def run(t: pa.Table, tree: np.ndarray, xyz: np.ndarray) -> pa.Table:
        n, ids = neighbours.counts(tree, xyz, t.column("radius2").to_numpy(), largest, t.column("point_id").to_numpy())
        return pa.table(ids_of(t) | {"n": n, "ids": ids}).filter(n > 0)

    out = by_tree(points, run, "tree_id long, point_id long, n long, ids long")
    if large is None:
        return out
    edge = largest * (1 + 1e-9)
    g = with_cells(large, (edge,) * 3)
    return out.union(radius_join(g, g, "radius2", edge).groupBy("a.tree_id", "a.point_id").agg(F.count("*").alias("n"), F.sum("b.point_id").alias("ids")))


def with_per_tree(df: DataFrame, *aggs: Column) -> DataFrame:
    """df and aggregates of its tree: partial sums, then a join of one row a tree, so that a large tree isn't one task's window."""
    per = df.groupBy(F.col("tree_id").alias("_tree")).agg(*aggs)
    return df.join(broadcast_below(per, BROADCAST_TREES), F.col("tree_id").eqNullSafe(F.col("_tree"))).drop("_tree")


def with_cells(points: DataFrame, edges: tuple[float, ...], names: tuple[str, ...] = ("ci", "cj", "ck")) -> DataFrame:
    """points and the cells that they lie in, counted from their tree's minima: floor((c - min) / edge)."""
    axes = AXES[: len(edges)]
    df = with_per_tree(points, *(F.min(a).alias(f"_min_{a}") for a in axes))
    cells = {n: F.floor((F.col(a) - F.col(f"_min_{a}")) / e).cast("long") for n, a, e in zip(names, axes, edges, strict=False)}
    return df.withColumns(cells).drop(*(f"_min_{a}" for a in axes))


def stencil(df: DataFrame, reach: int | Column, names: tuple[str, ...] = ("ci", "cj", "ck")) -> DataFrame:
    """df with each row in all cells up to `reach` away, which may be a column."""
    r = F.lit(reach) if isinstance(reach, int) else reach
    for n in names:
        df = df.withColumn(n, F.explode(F.sequence(F.col(n) - r, F.col(n) + r)))
    return df


def d2(a: str, b: str) -> Column:
    """Squared distance of the points of two aliases."""
    return sum(((F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) for c in AXES[1:]), (F.col(f"{a}.x") - F.col(f"{b}.x")) * (F.col(f"{a}.x") - F.col(f"{b}.x")))


def radius_join(a: DataFrame, b: DataFrame, radius2: float | str, edge: float) -> DataFrame:
    """Pairs (alias a, alias b) of one tree with squared distance below radius2 (a number, or a column of a).

    Cells have `edge`, at least the largest radius; b's rows go to the 27 cells round their own, and cells are joined.
    Both sides must carry (tree_id, ci, cj, ck) of the same grid.
    """
    limit = F.lit(radius2) if not isinstance(radius2, str) else F.col(f"a.{radius2}")
    keys = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("tree_id", "ci", "cj", "ck")]
    return a.alias("a").join(stencil(b, 1).alias("b"), keys).filter(d2("a", "b") < limit)


def kth_distance(points: DataFrame, k: int, edge: float) -> DataFrame:
    """(tree_id, point_id, distance) to the k-th nearest point of the tree, the point itself counted; null in trees of fewer.

    Points still open look into the 27 cells round them; a k-th distance of at most the cells' edge is final. For the
    others the edge doubles, so a stray point asks 27 cells however far it stands off. Of a point's candidates each
    partition passes on the k nearest (a limited window). Trees that a task can hold do the same in arrays.
    """
    points, large = parted(points)

    def run(t: pa.Table, tree: np.ndarray, xyz: np.ndarray) -> pa.Table:
        return pa.table(ids_of(t) | {"distance": pa.array(neighbours.kth(tree, xyz, k, edge), from_pandas=True)})

    out = by_tree(points.select("tree_id", "point_id", *AXES), run, "tree_id long, point_id long, distance double")
    return out if large is None else out.union(kth_distance_joined(large, k, edge))


def kth_distance_joined(points: DataFrame, k: int, edge: float) -> DataFrame:
    """kth_distance of trees of any size, by joins of cells."""
    lows = [F.min(c).alias(f"_l{c}") for c in AXES]
    grid = with_per_tree(points, *lows, *(F.max(c).alias(f"_h{c}") for c in AXES), F.count("*").alias("_n"))
    span = F.greatest(*(F.col(f"_h{c}") - F.col(f"_l{c}") for c in AXES))
    grid = cut(grid.select("tree_id", "point_id", *AXES, *(f"_l{c}" for c in AXES), span.alias("_span"), "_n"))
    out = grid.filter(F.col("_n") < k).select("tree_id", "point_id", F.lit(None).cast("double").alias("distance"))
    left = grid.filter(F.col("_n") >= k)

    def celled(df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.floor((F.col(c) - F.col(f"_l{c}")) / edge).cast("long") for n, c in zip(("ci", "cj", "ck"), AXES, strict=True)})

    while True:
        keys = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("tree_id", "ci", "cj", "ck")]
        spread = broadcast_below(stencil(celled(left), 1).select("tree_id", "point_id", *AXES, "_span", "ci", "cj", "ck"), BROADCAST_OPEN)
        near = celled(grid).alias("a").join(spread.alias("b"), keys).select("b.tree_id", "b.point_id", "b._span", d2("a", "b").alias("d2"))
        rank = Window.partitionBy("tree_id", "point_id").orderBy("d2")
        kth = near.withColumn("k", F.row_number().over(rank)).filter(F.col("k") == k).select(F.col("tree_id").alias("k_tree"), F.col("point_id").alias("k_point"), F.sqrt("d2").alias("distance"), "_span")
        final = cut(kth.filter((F.col("distance") <= edge) | (F.col("_span") < edge)).drop("_span"))
        out = out.union(final)
        left = cut(left.join(final, (F.col("tree_id") == F.col("k_tree")) & (F.col("point_id") == F.col("k_point")), "left_anti"))
        if not left.limit(1).count():
            return out
        edge *= 2


def closest(a: DataFrame, b: DataFrame, keys: list[str], relaxed: Column | None = None) -> DataFrame:
    """For each key the pair of points of a and b (keys, id, x, y, z) of least (relaxed, distance, ids), as a struct m.

    Cells begin with an edge of the key's span over the cube root of its points, and pairs of neighbouring cells are compared;
    an unrelaxed pair at most an edge apart is final. For the other keys the edge doubles, up to their span. So only a key
    whose points lie far apart, or have no unrelaxed pair, compares many of them.
    """
    every = a.select(*keys, *AXES).union(b.select(*keys, *AXES))
    span = F.greatest(*(F.max(c) - F.min(c) for c in AXES))
    box = every.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(*(F.min(c).alias(f"_l{c}") for c in AXES), span.alias("_span"), F.count("*").alias("_n"))
    box = cut(box.withColumn("_edge", F.when(F.col("_span") > 0, F.col("_span") / F.cbrt("_n")).otherwise(1.0)).drop("_n"))
    small = broadcast_below(box, BROADCAST_TREES)
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    a, b = (cut(df.select(*keys, "id", *AXES).join(small, same).drop(*(f"_{k}" for k in keys))) for df in (a, b))
    steps = box.agg(F.max(F.col("_span") / F.col("_edge")).alias("n")).first().n
    out, factor = None, 1

    def celled(df: DataFrame) -> DataFrame:
        return df.withColumns({n: F.floor((F.col(c) - F.col(f"_l{c}")) / (F.col("_edge") * factor)).cast("long") for n, c in zip(("ci", "cj", "ck"), AXES, strict=True)})

    while True:
        pairs = stencil(celled(a), 1).alias("a").join(celled(b).alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*keys, "ci", "cj", "ck")])
        if relaxed is not None:
            pairs = pairs.filter(d2("a", "b") > 0)
        rank = F.lit(0).cast("long") if relaxed is None else relaxed
        best = F.min(F.struct(rank.alias("relaxed"), d2("a", "b").alias("d2"), F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))).alias("m")
        found = pairs.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a._edge").alias("_edge"), F.col("a._span").alias("_span")).agg(best)
        reach = F.col("_edge") * factor
        final = cut(found.filter(((F.col("m.relaxed") == 0) & (F.sqrt("m.d2") <= reach)) | (reach >= F.col("_span"))).select(*keys, "m"))
        out = final if out is None else out.union(final)
        if steps is None or factor >= steps:
            return out
        done = broadcast_below(final.select(*(F.col(k).alias(f"_{k}") for k in keys)), BROADCAST_TREES)
        a, b = (cut(df.join(done, same, "left_anti")) for df in (a, b))
        if not a.limit(1).count():
            return out
        factor *= 2


def nearest_pair(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """For each key the closest pair of points of a and b: (keys, a_id, b_id, distance), ties to the smaller ids.

    Both sides hold points (keys, id, x, y, z).
    """
    return closest(a, b, keys).select(*keys, "m.a_id", "m.b_id", F.sqrt("m.d2").alias("distance"))


def nearest_above(a: DataFrame, b: DataFrame, keys: list[str], least: float = 0.7, step: float = 0.05) -> DataFrame:
    """For each key the closest pair whose connection from a to b is steep: its cosine to the vertical is above `least`, or
    if there is none above the first of least - step, least - 2 step, ... that has any."""
    cosine = (F.col("b.z") - F.col("a.z")) / F.sqrt(d2("a", "b"))
    relaxed = F.greatest(F.lit(0), F.floor(F.round((least - cosine) / step, 9)) + 1).cast("long")
    return closest(a, b, keys, relaxed).select(*keys, "m.relaxed", "m.a_id", "m.b_id", F.sqrt("m.d2").alias("distance"))


def nearest_cylinders(cylinders: DataFrame, k: int = 4) -> DataFrame:
    """(tree_id, branch, cyl_id, rank, distance2): for the first cylinder of each branch with a parent, the k cylinders of
    the parent's branch whose starts are nearest; ties to the smaller id."""
    first = cylinders.filter("position = 1 and parent is not null").alias("a")
    owner = cylinders.select("tree_id", F.col("cyl_id").alias("parent"), F.col("branch").alias("p_branch")).alias("o")
    mine = first.join(owner, ["tree_id", "parent"]).select("tree_id", "branch", "p_branch", F.col("start_x").alias("x"), F.col("start_y").alias("y"), F.col("start_z").alias("z")).alias("a")
    other = cylinders.select("tree_id", F.col("branch").alias("o_branch"), "cyl_id", F.col("start_x").alias("x"), F.col("start_y").alias("y"), F.col("start_z").alias("z")).alias("b")
    near = mine.join(other, (F.col("a.tree_id") == F.col("b.tree_id")) & (F.col("p_branch") == F.col("o_branch"))).select("a.tree_id", "branch", "cyl_id", d2("a", "b").alias("distance2"))
    rank = Window.partitionBy("tree_id", "branch").orderBy("distance2", "cyl_id")
    return near.withColumn("rank", F.row_number().over(rank).cast("long")).filter(F.col("rank") <= k)
