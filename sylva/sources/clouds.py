"""Sources of point clouds and sinks of models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINT = ["tree_id", "point_id", "x", "y", "z"]


def points_from(df: DataFrame, x: str = "x", y: str = "y", z: str = "z", tree: str | None = None, point: str | None = None) -> DataFrame:
    """Any table with three coordinates as points: cast to double, other columns dropped. Without ids, one tree whose points
    are numbered by a hash-free, repeatable rank of their coordinates would need a sort; so an id column must be named, or
    ids are unique but not dense."""
    ids = [F.col(tree).cast("long") if tree else F.lit(1).cast("long"), F.col(point).cast("long") if point else F.monotonically_increasing_id()]
    return df.select(ids[0].alias("tree_id"), ids[1].alias("point_id"), *(F.col(c).cast("double").alias(n) for c, n in zip((x, y, z), "xyz", strict=True)))


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """Points of a container: tree ids by name, from 1. Files and row groups without the names asked for aren't read."""
    d = spark.read.parquet(path)
    names = d.select("tree_name").distinct().withColumn("tree_id", F.row_number().over(Window.orderBy("tree_name")).cast("long"))  # a row a tree
    return d.join(F.broadcast(names) if names.limit(100_001).count() <= 100_000 else names, "tree_name").select("tree_name", *POINT)


def write_container(points: DataFrame, path: str) -> None:
    """Points with tree_name, in ranges of names: a tree is read by the statistics of its files, and trees of any number make no
    more files than there are ranges. A tree of most points is in several."""
    points.drop("tree_id").repartitionByRange("tree_name", "point_id").sortWithinPartitions("tree_name", "point_id").write.mode("overwrite").parquet(path)


def save_models(tables: dict[str, DataFrame], path: str) -> None:
    """A model's tables (cylinder, branch, attributes, ...) by name, each in a folder of its own, in ranges of trees."""
    for name, t in tables.items():
        t.repartitionByRange("tree_id").sortWithinPartitions("tree_id").write.mode("overwrite").parquet(f"{path}/{name}")


def load_models(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def text_tables(cylinders: DataFrame, branches: DataFrame, attributes: DataFrame) -> dict[str, DataFrame]:
    """What the text files hold: cylinders to 4 decimals, branches to as many as their measure needs, attributes as (name, value)."""
    places = {"diameter": 4, "volume": 4, "area": 4, "length": 3, "angle": 1, "height": 3, "azimuth": 1, "zenith": 1}
    c = cylinders.select(*(F.round(n, 4).alias(n) if t == "double" else F.col(n) for n, t in cylinders.dtypes))
    b = branches.select(*(F.round(n, places[n]).alias(n) if n in places else F.col(n) for n in branches.columns))
    names = [n for n in attributes.columns if n != "tree_id"]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names)))
    return {"cylinder": c, "branch": b, "attributes": attributes.select("tree_id", rows.alias("r")).select("tree_id", "r.*")}


def save_text(tables: dict[str, DataFrame], path: str) -> None:
    """Tab separated files with headers, one folder a table."""
    for name, t in tables.items():
        t.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/{name}")


#: Trees of a matrix that has a column for each.
MATRIX_TREES = 1000


def save_matrix(statistics: DataFrame, path: str, value: str = "mean") -> None:
    """(tree_id, attribute, value) as a tab separated matrix: a row an attribute, a column a tree. Over MATRIX_TREES trees, one
    row an attribute and tree."""
    trees = [r.tree_id for r in statistics.select("tree_id").distinct().orderBy("tree_id").limit(MATRIX_TREES + 1).collect()]
    long = statistics.select("attribute", "tree_id", value)
    m = long.groupBy("attribute").pivot("tree_id", trees).agg(F.first(value)) if len(trees) <= MATRIX_TREES else long
    m.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
