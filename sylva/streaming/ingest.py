"""Point clouds that arrive in files, kept as first points of cells without reading what is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

POINTS = "tree_id long, point_id long, x double, y double, z double"


def read_points(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A stream of the parquet files of points that appear in a folder."""
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files).parquet(path)


def first_of_cells(points: DataFrame, edge: float) -> DataFrame:
    """A stream of each cell's first point to arrive; cells count from the origin, as minima aren't known yet. The state is a key a
    cell and is kept, so it grows with the space covered, not with the points."""
    cells = {n: F.floor(F.col(a) / edge).cast("long") for n, a in zip(("ci", "cj", "ck"), "xyz", strict=True)}
    return points.withColumns(cells).dropDuplicates(["tree_id", "ci", "cj", "ck"])


def write_points(points: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what there is to a table with a part a tree, then stops; a later run goes on from the checkpoint."""
    return points.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("tree_id").outputMode("append").trigger(availableNow=True).start()
