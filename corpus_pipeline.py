"""The corpus pipeline: five stages over the documents table, each one operator of passagekit.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's rows to the shared folder and reads them again for the next, so
a lost executor costs no more than the stage it was in.

Rows that repeat a doc_id are one document to the stages that join on it; rows without a doc_id pass the
two deduplicating stages unchanged. Null texts do not survive the first stage; empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekit.llm.language import UNKNOWN, predict_rows
from passagekit.llm.lines import dedup_lines
from passagekit.llm.packing import pack_documents
from passagekit.llm.pii import redact_rows
from passagekit.llm.rows import with_text
from passagekit.llm.simhash import near_dedup
from passagekit.runtime import ensure_checkpoint_dir, table

#: A document is rejected when it has no letter or when its language is a guess.
LEAST_LANGUAGE_SCORE = 0.3
VOCABULARY = "byte_bpe_50k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty; the rest (no letter, or a score under LEAST_LANGUAGE_SCORE) go."""
    kept = predict_rows(docs).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that nearly repeat an earlier line of the corpus."""
    return with_text(dedup_lines(docs), "text")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates on five-word shingles: the smallest doc_id."""
    return near_dedup(docs, size=5)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with placeholders for personal data."""
    return with_text(redact_rows(docs), "text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1,024 tokens: one row for each piece of a document and its place."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses none of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
