"""Queries on sources, sinks, parameters and reports, and those that put operators together."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import attributes, branches, simplify
from .plans.lineage import checkpoints
from .queries import K1, L1, L3, register
from .sources import clouds, params
from .sources.fixtures import cte, load


def folder(spark: SparkSession) -> str:
    """A new folder among the checkpoints, which all executors share."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid4()}"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/lineitem.parquet")


@register(
    "a1_matrix_source",
    "SELECT l_suppkey::BIGINT AS tree_id, (l_orderkey*10+l_linenumber)::BIGINT AS point_id, l_quantity::DOUBLE AS x, l_discount::DOUBLE AS y, l_linenumber::DOUBLE AS z FROM lineitem",
)
def a1(spark, d):
    rows = lines(spark, d).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return clouds.points_from(rows, "l_quantity", "l_discount", "l_linenumber", "l_suppkey", "id")


NAMED = "SELECT 'tree_' || tree_id AS tree_name, point_id, x, y, z FROM points"


@register("a2_container", cte("points", n=NAMED) + " SELECT tree_name, dense_rank() OVER (ORDER BY tree_name)::BIGINT AS tree_id, point_id, x, y, z FROM n")
def a2(spark, d):
    path = folder(spark)
    clouds.write_container(load(spark, d, "points").withColumn("tree_name", F.concat(F.lit("tree_"), F.col("tree_id"))), path)
    return clouds.read_container(spark, path)


DEFAULTS = {
    "patch_diam1": (0.08, 0.12), "patch_diam2_min": (0.02, 0.03), "patch_diam2_max": (0.07, 0.1), "ball_rad1": (0.095, 0.135), "ball_rad2": (0.08, 0.11), "nmin1": (3,), "nmin2": (1,), "only_tree": (1,), "tria": (0,), "dist": (1,),
    "min_cyl_rad": (0.0025,), "parent_cor": (1,), "taper_cor": (1,), "growth_vol_cor": (0,), "growth_vol_fac": (1.5,), "tree": (1,), "model": (1,),
    "filter.k": (10,), "filter.radius": (0,), "filter.nsigma": (1.5,), "filter.patch_diam1": (0.05,), "filter.ball_rad1": (0.075,), "filter.ncomp": (2,), "filter.edge_length": (0.004,),
}


@register("a3_defaults", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {i + 1}, {float(v)}e0)" for n, vs in DEFAULTS.items() for i, v in enumerate(vs)) + ") t(name, place, value)")
def a3(spark, d):
    return params.defaults_table(spark)


@register("a6_saved_models", cte("cylinders", k1=K1) + """ SELECT 'cylinder' AS saved, tree_id, count(*) AS n, sum(length) AS total FROM cylinders GROUP BY 2 UNION ALL SELECT 'branch', tree_id, count(*), sum(volume) FROM k1 GROUP BY 2""")
def a6(spark, d):
    c, path = load(spark, d, "cylinders"), folder(spark)
    clouds.save_models({"cylinder": c, "branch": branches.branch_table(c)}, path)
    back = clouds.load_models(spark, path, ["cylinder", "branch"])
    each = lambda n, value: back[n].groupBy(F.lit(n).alias("saved"), "tree_id").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return each("cylinder", "length").union(each("branch", "volume"))


def kept(rows: DataFrame, text: DataFrame, keys: list[str], half: dict[str, float]) -> DataFrame:
    """rows(keys, ...), of which the columns named in half are null where a text file's value is over half a unit off."""
    t = text.select(*keys, *(F.col(n).alias(f"t_{n}") for n in half))
    same = [F.when(F.abs(F.col(n) - F.col(f"t_{n}")) <= h * (1 + 1e-6), F.col(n)).alias(n) if n in half else F.col(n) for n, h in ((n, half.get(n, 0)) for n in rows.columns)]
    return rows.join(t, keys).select(*same)


@register("a7_text_cylinders", cte("cylinders") + " SELECT tree_id, cyl_id, radius, length, start_z, parent, branch_order FROM cylinders")
def a7(spark, d):
    """To the decimals of the text file: values that these keep to within half a unit."""
    c, path = load(spark, d, "cylinders"), folder(spark)
    clouds.save_text({"cylinder": clouds.text_tables(c, branches.branch_table(c), c.select("tree_id", "radius"))["cylinder"]}, path)
    read = spark.read.option("sep", "\t").option("header", True).schema(c.schema).csv(f"{path}/cylinder")
    return kept(c.select("tree_id", "cyl_id", "radius", "length", "start_z", "parent", "branch_order"), read, ["tree_id", "cyl_id"], dict.fromkeys(("radius", "length", "start_z"), 5e-5))


@register("a7_text_branches", cte("cylinders", k1=K1) + ' SELECT tree_id, branch, "order", diameter, volume, area, length, height, azimuth, zenith FROM k1')
def a7b(spark, d):
    c = load(spark, d, "cylinders")
    b = branches.branch_table(c).select("tree_id", "branch", "order", "diameter", "volume", "area", "length", "height", "azimuth", "zenith")
    text = clouds.text_tables(c, b, c.select("tree_id", "radius"))["branch"]
    return kept(b, text, ["tree_id", "branch"], {"diameter": 5e-5, "volume": 5e-5, "area": 5e-5, "length": 5e-4, "height": 5e-4, "azimuth": 0.05, "zenith": 0.05})


@register("a8_suffixes", "SELECT (((h*2)+i)*2+j+1)::BIGINT AS combination, '_D' || a || '_DA' || b || '_DI' || c AS suffix FROM (VALUES (0, '0.08'), (1, '0.12')) x(h, a), (VALUES (0, '0.07'), (1, '0.1')) y(i, b), (VALUES (0, '0.02'), (1, '0.03')) z(j, c)")
def a8(spark, d):
    return params.suffix_table(spark, params.Params())


@register("a9_matrix_text", cte("cylinders") + ", m AS (SELECT tree_id, avg(radius) AS radius, avg(length) AS length, avg(mad) AS mad FROM cylinders GROUP BY 1) UNPIVOT (SELECT tree_id, radius, length, mad FROM m) ON radius, length, mad INTO NAME attribute VALUE mean")
def a9(spark, d):
    """Written as a matrix of trees below 1,000 trees, else as rows; read back as rows."""
    path, names = folder(spark), ["radius", "length", "mad"]
    means = load(spark, d, "cylinders").groupBy("tree_id").agg(*(F.avg(n).alias(n) for n in names))
    long = means.unpivot("tree_id", names, "attribute", "mean")
    clouds.save_matrix(long, path)
    read = spark.read.option("sep", "\t").option("header", True).csv(path)
    if "tree_id" not in read.columns:
        read = read.unpivot("attribute", [c for c in read.columns if c != "attribute"], "tree_id", "mean")
    return read.filter("mean is not null").select("attribute", F.col("tree_id").cast("long").alias("tree_id"), F.col("mean").cast("double").alias("mean"))


@register("a10_report", "SELECT o_orderkey, floor(o_totalprice/60)::BIGINT AS minutes, o_totalprice-60*floor(o_totalprice/60) AS seconds FROM orders")
def a10(spark, d):
    orders = spark.read.parquet(f"{d.rstrip('/')}/orders.parquet")
    minutes, seconds = vectors.minutes_and_seconds(F.col("o_totalprice"))
    return orders.select("o_orderkey", minutes.cast("long").alias("minutes"), seconds.cast("double").alias("seconds"))


_UNIT = "CASE " + " ".join(f"WHEN contains(name, '{w}') THEN '{u}'" for w, u in reversed(attributes.UNITS.items())) + " ELSE '' END"


@register(
    "l17_unit_labels",
    cte("cylinders", t=L1) + f", n AS (UNPIVOT (SELECT tree_id, total_volume, trunk_length, total_area, tree_height FROM t) ON total_volume, trunk_length, total_area, tree_height INTO NAME name VALUE value) SELECT tree_id, name, value, {_UNIT} AS unit FROM n",
)
def l17(spark, d):
    t = attributes.totals(load(spark, d, "cylinders"))
    return attributes.with_units(t.unpivot("tree_id", ["total_volume", "trunk_length", "total_area", "tree_height"], "name", "value")).select("tree_id", "name", "value", "unit")


AXES_OF = """SELECT tree_id, cyl_id, axis_x AS ax, axis_y AS ay, axis_z AS az, abs(axis_x)<=abs(axis_y) AND abs(axis_x)<=abs(axis_z) AS on_x, abs(axis_y)<=abs(axis_z) AS on_y FROM cylinders"""
#: The axis crossed with the coordinate direction that it holds least of, and the axis crossed with that.
FIRST = """SELECT *, CASE WHEN on_x THEN 0 WHEN on_y THEN -az ELSE ay END AS px, CASE WHEN on_x THEN az WHEN on_y THEN 0 ELSE -ax END AS py, CASE WHEN on_x THEN -ay WHEN on_y THEN ax ELSE 0 END AS pz FROM o"""
UNITS_OF = "SELECT tree_id, cyl_id, ax, ay, az, px/sqrt(px*px+py*py+pz*pz) AS ux, py/sqrt(px*px+py*py+pz*pz) AS uy, pz/sqrt(px*px+py*py+pz*pz) AS uz FROM f"


@register("j9_orthonormal", cte("cylinders", o=AXES_OF, f=FIRST, u=UNITS_OF) + " SELECT tree_id, cyl_id, ux, uy, uz, ay*uz-az*uy AS vx, az*ux-ax*uz AS vy, ax*uy-ay*ux AS vz FROM u")
def j9(spark, d):
    u, v = vectors.basis(vectors.vec("axis"))
    return load(spark, d, "cylinders").select("tree_id", "cyl_id", *(c.alias(f"{n}{a}") for n, w in (("u", u), ("v", v)) for a, c in zip("xyz", w, strict=True)))


RINGS = """SELECT c.*, r.ring, s.side FROM (SELECT c.*, u.ux, u.uy, u.uz, ay*uz-az*uy AS vx, az*ux-ax*uz AS vy, ax*uy-ay*ux AS vz FROM cylinders c JOIN u USING (tree_id, cyl_id)) c,
 (SELECT unnest(range(1, 5)) AS ring) r, (SELECT unnest(range(0, 12)) AS side) s WHERE (branch=1 OR ring=1) AND (branch=1 OR side<4)"""
_AT = "start_{0}+axis_{0}*(length*ring/CASE WHEN branch=1 THEN 4 ELSE 1 END)+(u{0}*cos(2*pi()*side/CASE WHEN branch=1 THEN 12 ELSE 4 END)+v{0}*sin(2*pi()*side/CASE WHEN branch=1 THEN 12 ELSE 4 END))*radius AS {0}"
_ENDS = "SELECT tree_id, cyl_id, start_x AS x, start_y AS y, start_z AS z FROM cylinders UNION ALL SELECT tree_id, cyl_id, start_x+axis_x*length, start_y+axis_y*length, start_z+axis_z*length FROM cylinders"


@register(
    "l4_model_point_sums",
    cte("cylinders", o=AXES_OF, f=FIRST, u=UNITS_OF, g=RINGS, p="SELECT tree_id, cyl_id, " + ", ".join(_AT.format(a) for a in "xyz") + " FROM g UNION ALL " + _ENDS, q="SELECT DISTINCT tree_id, x, y, z FROM p")
    + " SELECT tree_id, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, max(z) AS top, min(z) AS low FROM q GROUP BY 1",
)
def l4(spark, d):
    p = attributes.model_points(load(spark, d, "cylinders"))
    return p.groupBy("tree_id").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in "xyz"), F.max("z").alias("top"), F.min("z").alias("low"))


@register("p1_simplify")
def p1(spark, d):
    return simplify.simplify(load(spark, d, "cylinders"), 2, 0.02, 1)


CUT = "SELECT * FROM cylinders WHERE branch_order<=1"


@register(
    "p5_refresh",
    cte("cylinders", c1=CUT, t=L1.replace("FROM cylinders", "FROM c1"), w=L3) + " SELECT tree_id, t.total_volume, t.total_length, t.branch_area, t.number_branches, t.max_branch_order, t.tree_height, w.dbh_qsm FROM t LEFT JOIN w USING (tree_id)",
)
def p5(spark, d):
    c = load(spark, d, "cylinders")
    before = attributes.totals(c).join(attributes.dbh_from_cylinders(c), "tree_id")
    _, new = simplify.refresh(simplify.truncate_order(c, 1), before)
    return new.select("tree_id", "total_volume", "total_length", "branch_area", "number_branches", "max_branch_order", "tree_height", "dbh_qsm")
