"""The cleaning pipeline over ``documents``: quality rules, exact and near dedup, secrets, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from krysalis.llm import common, exact, packing, quality, secrets, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs).filter(F.col("quality.kept")).select(*COLUMNS)


def exact_stage(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return exact.exact_dedup(docs).select(*COLUMNS)


def near_stage(spark, docs, sf_dir):
    """One document of each near-duplicate group."""
    return simhash.simhash_dedup(docs).select(*COLUMNS)


def secrets_stage(spark, docs, sf_dir):
    """The same documents with their secrets replaced; the character count follows."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def packing_stage(spark, docs, sf_dir):
    """Token pieces with their places in sequences of 1,024."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]
#: Fingerprints, compression ratios and token ids are not SQL: the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over ``documents``, each written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
