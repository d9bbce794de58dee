"""From raw documents to packed sequences, stage by stage."""

from __future__ import annotations

import pathlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from cairnlog.llm import exact, pii, queries, simhash, toxicity
from cairnlog.session import ship_package, workspace


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of one half or more go; learned from the labelled ones among ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # columns of the input that are called like the operator's own wait under other names
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in ("score", "spans")}
    scored = toxicity.score(docs.withColumnsRenamed(own), toxicity.train(docs, labels))
    return scored.where("score < 0.5").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints the one with the smallest doc_id stays."""
    return simhash.keep_one(docs)


def private_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and the number of characters set anew."""
    masked = pii.mask(docs, pii.learn(docs))
    return masked.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids."""
    return queries.packed(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("personal data", private_out),
    ("packing", packing),
]

#: Trained models, SimHash components and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = workspace(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
