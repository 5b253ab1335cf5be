"""From raw documents to token ids: toxicity, near-duplicates, benchmark passages, personal data,
SentencePiece. Each stage takes (spark, docs, sf_dir); its result is written as Parquet in the
shared folder and read again by the next, so a lost executor costs at most one stage.

Rows without id pass the filters that need one. Empty documents pass all stages. All stages but the
last return the columns they get; the last returns doc_id, n_tokens, ids and the digests of the
ids and of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.llm import decontaminate, minhash_dedup, pii, sentencepiece_codec, toxicity
from tabassay.llm.tables import load, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity of 0.8 or more; the least id of a group stays."""
    return minhash_dedup.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, load(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.mask_pii(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(docs.select("doc_id", "text"), sentencepiece_codec.model_file())
    return encoded.select("*", *sentencepiece_codec.digest_columns()).select(
        "doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("sentencepiece", tokenise),
]

ORACLE_SQL = None  # a learned grammar and a tokenizer have no SQL; tests hold it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
