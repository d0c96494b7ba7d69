"""From raw documents to token ids: quality rules, near-duplicates, secrets, mixing, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoprofile.llm import mixing, pieces, quality, secret_scan, simhash
from topoprofile.runtime import materialize


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return quality.filter_quality(_documents(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(_documents(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; the character count follows."""
    clean = secret_scan.redact(secret_scan.find_secrets(_documents(docs)))
    return _documents(clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are replicated to their sources' weights and shuffled."""
    return _documents(mixing.poisson_mix(_documents(docs)))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every copy."""
    ids = pieces.encode(_documents(docs), pieces.default_model())
    return ids.select("doc_id", "lang", "source", "n_chars", F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("pieces", encoded),
]

#: XXH64 fingerprints and piece search have no SQL form: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
