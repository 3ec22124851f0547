"""From documents to packed sequences: quality, language, near duplicates, mixture, packing."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import langid, mixing, packing, quality, simhash_dedup
from sylva.llm.common import checkpoints, read

#: Pieces of text whose ids a worker keeps: half of op10's, for here an executor holds what the other stages left, too.
PIECES = packing.CACHE // 2


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned on the labels, scores 0.5 or more."""
    model = quality.learn(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return quality.score(rows, model, ["row"]).filter("score >= 0.5").select("row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose n-grams lie near a language's centroid."""
    return langid.keep(docs, langid.learn(docs))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash_dedup.near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: a document taken twice is in two rows."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack(docs, packing.tokenizer_path(), PIECES)


STAGES = [("quality", good_quality), ("language", known_language), ("near_dedup", one_of_near_duplicates), ("mixing", mixture), ("packing", packed)]
#: SQL cannot express the classifiers and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def written(docs: DataFrame, name: str) -> DataFrame:
    """docs as Parquet in the shared checkpoint folder, read again: the next stages read the columns that they need."""
    checkpoints(docs.sparkSession)
    path = f"{docs.sparkSession.sparkContext.getCheckpointDir()}/{uuid4()}-{name}"
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
