"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import broadcast_below, checkpoints, cut  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def hash_third(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 3. 1 is held out; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


#: Bytes of an Arrow batch, after which the next row begins another.
BATCH_BYTES = 32 << 20


def batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds Arrow batches of the session, in rows and bytes, so that a batch of long texts stays small in a Python worker; a
    lower bound that is set already stays."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
