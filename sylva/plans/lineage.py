"""Cutting lineage in the folder that all executors share, and broadcasts behind a check of size."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """The checkpoint folder is the cluster's (spark.checkpoint.dir); only a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = f"/tmp/checkpoints/{os.getuid()}"
        sc.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """df computed once and held in the shared checkpoint folder, where it outlives executors."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def cut_plain(df: DataFrame) -> DataFrame:
    """cut() without what the optimizer knew of the rows: unions of checkpoints whose filters it remembers can fail to plan."""
    key, conf = "spark.sql.constraintPropagation.enabled", df.sparkSession.conf
    before = conf.get(key)
    conf.set(key, "false")
    try:
        return cut(df)
    finally:
        conf.set(key, before)


#: Bytes of a table that is broadcast, at most; a row counts 16 bytes besides what its columns hold.
BROADCAST_BYTES = 64 << 20


def width(c: str, kind: str) -> Column:
    """Bytes of a column's value, about."""
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def broadcast_below(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes; else as it is, for a shuffled join.

    Only the first rows + 1 are counted and measured, so a table that grows is never read further than that.
    """
    total = sum((width(f"`{c}`", t) for c, t in df.dtypes), F.lit(16))
    r = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(total).alias("bytes")).first()
    return F.broadcast(df) if r.n <= rows and (r.bytes or 0) <= size else df
