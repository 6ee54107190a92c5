"""Chunk records as JSON lines, one folder a paper, and other files of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "id string, kind string, text string, math array<string>, tokens array<string>"


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """(arxiv_id, id, kind, text, math, tokens) of root/<paper>/chunks.jsonl; lines that are no record are skipped."""
    rows = spark.read.schema(CHUNK_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE")
    rows = rows.json(f"{root.rstrip('/')}/*/chunks.jsonl")
    rows = rows.where(F.col("_bad").isNull() & F.col("id").isNotNull()).drop("_bad")
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(F.url_decode(F.regexp_replace(folder, r"\+", "%2B")).alias("arxiv_id"), "id", "kind", "text", "math", "tokens")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk records as JSON lines in a folder per paper."""
    chunks.write.partitionBy("arxiv_id").json(path)


def write_vectors(path: str, vocabulary: DataFrame, weights: DataFrame) -> None:
    """Vocabulary with df, and sparse vectors, as tables under path, in place of files per paper."""
    vocabulary.write.parquet(f"{path}/vocabulary")
    weights.write.parquet(f"{path}/vectors")


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    """(chunk_id, v) as a table that replaces the one at path."""
    embeddings.select("chunk_id", F.col("v").cast("array<float>").alias("v")).write.mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str, chunk_ids: DataFrame | None = None) -> DataFrame:
    """(chunk_id, v), of chunk_ids only if given."""
    rows = spark.read.parquet(path)
    return rows if chunk_ids is None else rows.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def read_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """(arxiv_id) of a text file with one paper folder a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("arxiv_id")).where("arxiv_id <> ''")
