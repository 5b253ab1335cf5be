"""Reading inputs, staging intermediate tables, and column helpers of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.table import scratch_path, stage

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType())])


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns an operator reads, under its own names; other columns cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"), *more)


def stage_texts(df: DataFrame, label: str) -> DataFrame:
    """``stage`` for whole texts, compressed harder."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_text_digest(column) -> F.Column:
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def hash_fold(column, parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(column.cast("string").cast("binary")) % parts


__all__ = ["DOCUMENTS", "fresh_name", "hash_fold", "load", "stage", "stage_texts", "texts", "with_text_digest"]
