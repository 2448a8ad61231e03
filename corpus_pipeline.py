"""A training-data pipeline of five stages over `documents`; each stage's rows are written and read again by the next.

1. toxicity drops documents that score 0.3 or more.
2. near_dedup keeps one document (the smallest id) of each group of near copies: sets of five-word
   shingles with a Jaccard similarity of 0.8 or more.
3. decontamination drops documents with benchmark passages of 13 words that make up a twentieth of them.
4. secret_scans replaces secrets in texts by a mark (and n_chars follows); it drops nothing.
5. sentencepiece encodes texts: ids of the best segmentation, scores of the four best, and whether
   the ids decode to the text.

ORACLE_SQL is None: neither the classifier nor the lattice search can be said in SQL. tests/llm
compares the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import decontam, neardup, pieces, secrets, toxicity
from docquarry.llm._io import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.train(secrets.samples(spark)))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(docs.select("doc_id", "lang", "source", "text"))
    same = F.col("pieces.decoded") == F.coalesce("text", F.lit(""))
    return encoded.select("doc_id", "lang", "source", F.size("pieces.ids").cast("long").alias("n_tokens"), F.col("pieces.ids").alias("ids"), F.col("pieces.scores").alias("scores"), same.alias("round_trip"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scans", secret_scans_stage),
    ("sentencepiece", sentencepiece_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
