"""The corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs has the columns of documents, and all stages but the last return them. A stage takes out the rows that its operator rejects, by id and text, so rows without an id and rows that repeat one are judged each; rows that repeat an id and its text share one verdict. Further columns of docs are kept whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm import decontaminate, exact_dedup, mixing, ngram_join, toxicity
from strataloom.llm.shared import lower_ascii, shared_dir


def _without(docs: DataFrame, gone: DataFrame, text: Column | None = None) -> DataFrame:
    """docs without the rows that gone (doc_id, th: hash of the text) lists."""
    gone = gone.select(F.struct("doc_id", "th").alias("_gone")).distinct()
    mine = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")) if text is None else text).alias("th"))
    return docs.join(gone, mine.eqNullSafe(F.col("_gone")), "left_anti")


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. The network is fitted on the labelled rows of docs."""
    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scored.where("score >= 0.5"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return _without(docs, exact_dedup.exact_dedup(docs).where("NOT kept"), lower_ascii(F.coalesce(F.col("text"), F.lit(""))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that n-gram Jaccard links connect, the least doc_id stays; one without an id stays only if none of them has one."""
    return _without(docs, ngram_join.jaccard_components(docs).where("NOT (doc_id <=> component_id)"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn to the target weights: doc_id, source, lang, topic, n_tokens, prob."""
    return mixing.mix(docs).where("sampled").drop("sampled")


STAGES = [("toxicity", clean_toxic), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("mixing", mixed)]

#: The toxicity network, the component search, the slots and the raking are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
