"""Trees made of the driver's order tables: the same SQL text gives the same rows in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Noisy vertical stems, one per supplier.
POINTS = """
SELECT CAST(l_suppkey AS BIGINT) AS tree_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,l_linenumber,l_partkey,l_extendedprice,l_quantity) AS BIGINT) AS point_id,
       (0.15e0+0.1e0*l_discount)*cos(2*pi()*(l_partkey%360)/360e0) AS x,
       (0.15e0+0.1e0*l_discount)*sin(2*pi()*(l_partkey%360)/360e0) AS y,
       l_quantity/10e0 + l_extendedprice/1e7 AS z
FROM lineitem"""

#: Tree = customer, branch = order, cylinder = line; branch b hangs on branch floor(b / 2). Zeniths avoid class edges.
CYLINDERS = """
SELECT tree_id, branch, position, branch*1000+position AS cyl_id, radius, length,
       0.05e0*branch AS start_x, 0.02e0*position AS start_y, (position+branch)*0.1e0 AS start_z,
       sin(zen)*cos(azi) AS axis_x, sin(zen)*sin(azi) AS axis_y, cos(zen) AS axis_z,
       CASE WHEN position>1 THEN branch*1000+position-1 WHEN branch>1 THEN CAST(floor(branch/2) AS BIGINT)*1000+1 END AS parent,
       CASE WHEN position<members THEN branch*1000+position+1 END AS extension,
       added, CAST(length(bin(branch))-1 AS BIGINT) AS branch_order, surf_cov, mad
FROM (SELECT b.o_custkey AS tree_id, b.branch,
        CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity) AS BIGINT) AS position,
        CAST(COUNT(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS members,
        (0.05e0+l_quantity/500e0)/b.branch AS radius, 0.1e0+l_extendedprice/2e5 AS length,
        radians((l_partkey%180)+0.5e0) AS zen, radians(((l_suppkey*37)%360)+0.5e0-180e0) AS azi,
        l_tax=0.08e0 AS added, l_discount*10 AS surf_cov, l_tax/10 AS mad
      FROM lineitem JOIN
        (SELECT o_orderkey, o_custkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate,o_orderkey) AS BIGINT) AS branch
         FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) b ON l_orderkey=b.o_orderkey) c"""

#: Repeat models: trees x parameter combinations x repeats, with distances, coverage and attributes of each.
RUNS = """
SELECT CAST(l_suppkey%20 AS BIGINT) AS tree_id,
       CASE l_returnflag WHEN 'A' THEN 0.08e0 WHEN 'N' THEN 0.10e0 ELSE 0.12e0 END AS pd1,
       CASE l_linestatus WHEN 'F' THEN 0.02e0 ELSE 0.03e0 END AS pd2min,
       CASE WHEN l_linenumber<=3 THEN 0.07e0 ELSE 0.10e0 END AS pd2max,
       CAST(l_quantity AS BIGINT)%5+1 AS model,
       avg(l_discount)/10 AS mean_all, avg(l_tax)/10 AS mean_trunk, avg(l_discount+l_tax)/10 AS mean_branch, avg(l_quantity)/1e4 AS mean_branch1, avg(l_quantity*l_tax)/1e4 AS mean_branch2,
       max(l_discount)/5 AS max_all, max(l_tax)/5 AS max_trunk, max(l_discount+l_tax)/5 AS max_branch, max(l_quantity)/1e3 AS max_branch1, max(l_quantity*l_tax)/1e3 AS max_branch2,
       1-avg(l_discount) AS surf_all, 1-avg(l_tax) AS surf_trunk, 1-avg(l_discount+l_tax) AS surf_branch, 1-avg(l_quantity)/1e2 AS surf_branch1, 1-avg(l_quantity*l_tax)/1e2 AS surf_branch2,
       0.9e0-max(l_discount) AS low_all, 0.9e0-max(l_tax) AS low_trunk, 0.9e0-max(l_discount+l_tax) AS low_branch, 0.9e0-max(l_quantity)/1e2 AS low_branch1, 0.9e0-max(l_quantity*l_tax)/1e2 AS low_branch2,
       sum(l_extendedprice)/1e5 AS total_volume, sum(l_extendedprice*l_tax)/1e5 AS trunk_volume, sum(l_extendedprice*l_discount)/1e5 AS branch_volume,
       sum(l_quantity) AS total_area, sum(l_quantity*l_tax) AS trunk_area, sum(l_quantity*l_discount) AS branch_area,
       sum(l_tax) AS trunk_length, sum(l_discount) AS branch_length, CAST(count(*) AS DOUBLE) AS number_branches
FROM lineitem GROUP BY 1,2,3,4,5"""

#: Class sums of repeat models in long form: family (order, dia, zen), measure, class and value.
RUN_CLASSES = """
SELECT tree_id, pd1, pd2min, pd2max, model, family, measure, class, sum(v) AS value
FROM (SELECT CAST(l_suppkey%20 AS BIGINT) AS tree_id,
        CASE l_returnflag WHEN 'A' THEN 0.08e0 WHEN 'N' THEN 0.10e0 ELSE 0.12e0 END AS pd1,
        CASE l_linestatus WHEN 'F' THEN 0.02e0 ELSE 0.03e0 END AS pd2min,
        CASE WHEN l_linenumber<=3 THEN 0.07e0 ELSE 0.10e0 END AS pd2max,
        CAST(l_quantity AS BIGINT)%5+1 AS model, family, measure,
        CASE family WHEN 'order' THEN l_partkey%6+1 WHEN 'dia' THEN l_partkey%20+1 ELSE l_partkey%18+1 END AS class,
        CASE measure WHEN 'vol' THEN l_extendedprice/1e4 WHEN 'are' THEN l_quantity WHEN 'len' THEN l_quantity*(1+l_tax) ELSE 1e0 END AS v
      FROM lineitem CROSS JOIN (VALUES ('order','vol'),('order','are'),('order','len'),('order','num'),('dia','vol'),('dia','are'),('dia','len'),('zen','vol'),('zen','are'),('zen','len')) f(family, measure)) x
GROUP BY tree_id, pd1, pd2min, pd2max, model, family, measure, class"""

SQL = {"points": POINTS, "cylinders": CYLINDERS, "runs": RUNS, "run_classes": RUN_CLASSES}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture of that name over the tables of sf_dir, which are read with the columns that it uses only.

    Points are numbered below the expressions on them, so the columns read move once, not with what is made of them, and Spark
    knows that points of a tree lie together.
    """
    tables = {t: spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in ("lineitem", "orders")}
    text = SQL[name]
    if name == "points":
        rank = re.search(r"ROW_NUMBER\(\) OVER \([^)]*\)", text).group()
        text = text.replace(rank, "number").replace("FROM lineitem", f"FROM (SELECT *, {rank} AS number FROM lineitem)")
    text = text.replace("(SELECT l_orderkey FROM", "(SELECT DISTINCT l_orderkey FROM")  # equal keys needn't move
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **{t: df for t, df in tables.items() if f"{{{t}}}" in text})


def cte(*names: str, **more: str) -> str:
    """A WITH clause of the fixtures and of further queries, for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in {**{n: SQL[n] for n in names}, **more}.items())
