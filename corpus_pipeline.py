"""Documents to packed training sequences: five stages, each on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the
shared checkpoint folder and reads again as the next stage's docs.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelens.llm import line_dedup, lsh_forest, mixing, packing, queries, toxicity
from citelens.llm.shared import fresh, table, with_checkpoints

#: Expected severity from which a document goes, on the labels' own scale (0 clean, 1 toxic).
SEVERITY_LIMIT = 0.5
#: The model's result has no SQL form; tests hold each stage against a plain version instead.
ORACLE_SQL = None


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text where documents have it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(columns) if "n_chars" in columns else docs.select(columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the limit."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(spark, sf_dir, docs), limit=SEVERITY_LIMIT)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays.  Equal pages count once, so that near-dedup finds their text."""
    return _counted(line_dedup.drop_boilerplate_lines(docs, host="source", copies=False), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id, once; a null id is never a near copy."""
    found = lsh_forest.near_duplicates(docs)
    gone = found.filter(~F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    keyed = docs.withColumn(key := fresh(docs, "text_key"), F.xxhash64("text")).withColumn(other := fresh(docs, "other_key"), F.xxhash64(F.lit(77), "text"))
    left = keyed.join(gone, (F.col("doc_id") == F.col("gone_id")) & (F.col(key) == F.col("gone_key")), "left_anti")
    return left.dropDuplicates(["doc_id", key, other]).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents, or parts of them, as often as the mix takes them."""
    return _counted(mixing.mixed_documents(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_boilerplate), ("near_dedup", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{with_checkpoints(spark).sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
