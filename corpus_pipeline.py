"""The corpus pipeline over `documents`: language ID, near-dedup, decontamination, PII, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. SQL can't express the trained and hashed stages, so there is no ORACLE_SQL; tests compare the stages
with brute-force versions.

All stages take whole texts of any length and pass on all columns of documents, and no others. Rows may repeat, and ids
may be null or shared by several texts: rows are then told apart by their text. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustmill.functions.storage import saved
from trustmill.llm import decontaminate, language_id, pii, sentencepiece_codec, simhash
from trustmill.llm.common import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null and empty texts, and those without a letter. lang becomes the
    predicted one, of equally likely ones the first by name; repeated rows stay or go together. Where no row has both a
    label and a letter, nothing can be learned, and all go."""
    net = language_id.trained(language_id.training_sample(docs, ~language_id.held_out()))
    judged = language_id.predicted(docs, net)
    return judged.where(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, null ids last, ties by a hash of
    the text. Of rows equal in id and text one stays; null and blank texts are copies of each other."""
    return simhash.without_copies(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, repeated rows with them; null and empty texts hold none. Without
    benchmark items all stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; overlapping spans count as one, of the kind that starts first. Null texts
    stay null; repeated rows are redacted alike."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text. Null and empty texts have no ids; one row per
    row, repeated ones included."""
    out = sentencepiece_codec.coded(docs.select("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
