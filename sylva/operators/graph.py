"""Operators on graphs given as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, cut_plain


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges(a, b): component is the smallest node that can be reached.

    Alternating large and small stars: every round hangs each node's larger neighbours, then its smaller ones, on the
    smallest neighbour, until nothing changes. Rounds are few (logarithmic in the longest path in practice) and each is
    joins and minima over the edge table; nothing but a count and a checksum reaches the driver. The minima are cut
    apart from the joins so that a node of many edges is a skewed join side, which can be split.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.union(e.select("b", "a"))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")))
        large = cut(both.filter("b > a").join(low, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").distinct())
        low = cut(large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("n"), "m"))
        small = large.join(low, F.col("b") == F.col("n")).select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
        e = cut(small.union(low.select(F.col("m").alias("a"), F.col("n").alias("b"))).distinct())
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select("a", "a")).distinct()


def descendants(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree_id, node) of the roots (tree_id, node) and all that hang on them by parents (tree_id, node, parent).

    A frontier is joined to the parent table level by level; as many rounds as the forest is deep.
    """
    p = cut_plain(parents.filter("parent is not null").select("tree_id", "node", "parent"))
    front = cut_plain(roots.select("tree_id", "node").distinct())
    out = front
    while True:
        front = cut_plain(front.withColumnRenamed("node", "parent").join(p, ["tree_id", "parent"]).select("tree_id", "node").distinct().join(out, ["tree_id", "node"], "left_anti"))
        if not front.limit(1).count():
            return out
        out = out.union(front)


def levels(parents: DataFrame) -> DataFrame:
    """(tree_id, node, depth): roots (null parents) at 0, others one below their parent; nodes on a cycle are left out."""
    p = cut_plain(parents.select("tree_id", "node", "parent"))
    front = p.filter("parent is null").select("tree_id", "node", F.lit(0).cast("long").alias("depth"))
    out = front
    while True:
        front = cut_plain(front.select("tree_id", F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth")).join(p, ["tree_id", "parent"]).select("tree_id", "node", "depth"))
        if not front.limit(1).count():
            return out
        out = out.union(front)


def breadth_first(parents: DataFrame) -> DataFrame:
    """(tree_id, node, rank): level by level from the roots, by node within a level."""
    from pyspark.sql import Window

    w = Window.partitionBy("tree_id").orderBy("depth", "node")
    return levels(parents).select("tree_id", "node", F.row_number().over(w).cast("long").alias("rank"))


def branch_orders(parents: DataFrame) -> DataFrame:
    """(tree_id, node, order) of branches: the number of branch changes down to the trunk."""
    return levels(parents).withColumnRenamed("depth", "order")


def expand(edges: DataFrame, start: DataFrame, hops: int, forbidden: DataFrame | None = None) -> DataFrame:
    """(tree_id, node) within so many hops of the start nodes, never through or to forbidden nodes."""
    out = start.select("tree_id", "node").distinct()
    front = out
    e = edges.select("tree_id", F.col("src").alias("node"), "dst")
    for _ in range(hops):
        front = front.join(e, ["tree_id", "node"]).select("tree_id", F.col("dst").alias("node")).distinct()
        if forbidden is not None:
            front = front.join(forbidden.select("tree_id", "node"), ["tree_id", "node"], "left_anti")
        front = cut_plain(front.join(out, ["tree_id", "node"], "left_anti"))
        out = out.union(front)
    return out


def flood(edges: DataFrame, start: DataFrame, forbidden: DataFrame | None = None) -> DataFrame:
    """(tree_id, node) reachable from the start nodes without forbidden ones."""
    out = cut_plain(start.select("tree_id", "node").distinct())
    front = out
    e = cut_plain(edges.select("tree_id", F.col("src").alias("node"), "dst"))
    while True:
        front = front.join(e, ["tree_id", "node"]).select("tree_id", F.col("dst").alias("node")).distinct()
        if forbidden is not None:
            front = front.join(forbidden.select("tree_id", "node"), ["tree_id", "node"], "left_anti")
        front = cut_plain(front.join(out, ["tree_id", "node"], "left_anti"))
        if not front.limit(1).count():
            return out
        out = cut_plain(out.union(front))


def tree_components(edges: DataFrame, nodes: DataFrame, least: int = 1) -> DataFrame:
    """(tree_id, node, component, size) of nodes (tree_id, node) by edges (tree_id, src, dst) among them; components of
    fewer than `least` nodes are left out."""
    key = lambda c: F.struct(F.col("tree_id").alias("t"), F.col(c).alias("n"))
    inner = edges.join(nodes.select("tree_id", F.col("node").alias("src")), ["tree_id", "src"], "left_semi").join(nodes.select("tree_id", F.col("node").alias("dst")), ["tree_id", "dst"], "left_semi")
    c = components(inner.select(key("src").alias("a"), key("dst").alias("b"))).select(F.col("node.t").alias("tree_id"), F.col("node.n").alias("node"), F.col("component.n").alias("found"))
    labelled = cut_plain(nodes.select("tree_id", "node").distinct().join(c, ["tree_id", "node"], "left").withColumn("component", F.coalesce("found", "node")).drop("found"))
    sizes = labelled.groupBy("tree_id", "component").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return labelled.join(sizes, ["tree_id", "component"]).select("tree_id", "node", "component", "size")
