"""The corpus pipeline: five stages, each over all documents that the stage before it kept.

Every stage but the last returns the columns of documents; each result is written as Parquet and read again as the next
stage's documents. ORACLE_SQL is None: no stage but the removal of exact copies can be said in SQL, so tests hold the stages
against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import common, decontam, pieces, queries, secret_scan, simhash, toxicity

TOXIC = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at or over TOXIC go."""
    model = toxicity.fit_on_tables(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, TOXIC)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8).

    SimHash fingerprints are searched in the Gray-order index, then an exact prefix filter gives the pairs beyond its bits.
    """
    return simhash.dedup(docs, words=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; no document goes."""
    return secret_scan.redact(docs, secret_scan.fit_forest(secret_scan.builtin_findings(spark)))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, lossless of each document left."""
    return pieces.encode(docs, queries.PIECE_MODEL, at_once=256, remembered=60_000)  # the workers share their executor with what earlier stages left


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("pieces", pieces_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
