"""A training corpus from ``documents``: language, quality, near-duplicates, benchmark leaks, mix.

Each stage takes all that the one before kept and returns rows of it; all but
the last return the columns of documents as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontam, langid, minhash, mixing, quality
from helixframe.llm.common import written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: no letter, or too narrow a margin."""
    found = langid.identify(docs, langid.fit(docs))
    return found.where("not lang_rejected").select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score under 0.3, as in ``op7_quality``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score(F.col("text"), model) >= 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class, the one with the smallest id, and of rows with equal ids the one with the smallest row hash; rows without an id stay."""
    found = minhash.near_duplicates(docs.where("doc_id is not null"))
    kept = found.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("rows"))
    rows = docs.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi")
    # Repeated ids are told apart by a hash of the row, met by an aggregate; equal rows by a second one. Few ids need it.
    again = kept.where("rows > 1").select("doc_id")
    once = rows.join(again, "doc_id", "left_anti")
    many = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64(*docs.columns).alias("h"), F.struct(*docs.columns).alias("row"))).alias("least"))
    return once.unionByName(many.select("least.row.*")).unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds how many words the mix takes of each document; drops those it takes none of."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("language_id", language_id),
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Compression, sampling and singular vectors are beyond SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
