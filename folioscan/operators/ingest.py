"""Choosing what to ingest, and build modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.operators.indexing import Index, dense_ids, extend, index_from_chunks


def allowlisted(chunks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Chunk records of the papers in allowed (arxiv_id)."""
    return chunks.join(allowed.select("arxiv_id").distinct(), "arxiv_id", "left_semi")


def not_yet_present(chunks: DataFrame, present: DataFrame) -> DataFrame:
    """Chunk records of papers that present (arxiv_id) lacks; a null arxiv_id is never present."""
    return chunks.join(present.select("arxiv_id").where("arxiv_id is not null").distinct(), "arxiv_id", "left_anti")


def first_papers(chunks: DataFrame, n: int, shuffle_seed: int | None = None) -> DataFrame:
    """Chunk records of the first n papers in the order of arxiv_id, or of a seeded hash of it."""
    ids = chunks.where("arxiv_id is not null").select("arxiv_id").distinct()
    order = [F.col("arxiv_id")] if shuffle_seed is None else [F.xxhash64(F.lit(shuffle_seed), "arxiv_id"), F.col("arxiv_id")]
    return chunks.join(ids.orderBy(*order).limit(n), "arxiv_id", "left_semi")


def mini_dataset(chunks: DataFrame, papers: int = 50, chunks_each: int = 200, shuffle_seed: int | None = None) -> DataFrame:
    """At most chunks_each chunk records, in the order of their number and id, of each of the first papers."""
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    order = Window.partitionBy("arxiv_id").orderBy(number, "id")
    few = first_papers(chunks, papers, shuffle_seed).dropDuplicates(["arxiv_id", "id"])
    return few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= chunks_each).drop("_r")


def sharded(chunks: DataFrame, shards: int) -> DataFrame:
    """chunks with papers dealt round robin over shards, in the order of arxiv_id: adds shard."""
    ids = chunks.where("arxiv_id is not null").select("arxiv_id").distinct()
    dealt = dense_ids(ids, ["arxiv_id"], "_n").select("arxiv_id", F.pmod(F.col("_n") - 1, F.lit(shards)).cast("int").alias("shard"))
    return chunks.join(dealt, "arxiv_id")


def append_manifest(path: str, ids: DataFrame) -> None:
    """Append ids (arxiv_id) to the manifest table at path."""
    ids.select("arxiv_id").distinct().write.mode("append").parquet(path)


def build(
    chunks: DataFrame, mode: str = "full", present: Index | None = None, allowed: DataFrame | None = None, limit: int | None = None
) -> Index:
    """An index by mode: full (all chunk records), incremental (present with the records of papers that it lacks), recent (those alone).

    index-only is full without the step that makes chunk records, which is not part
    of this; sharded is full, as a plan is spread over tasks anyway. allowed
    and limit narrow the records first.
    """
    if mode not in ("full", "index-only", "sharded", "incremental", "recent"):
        raise ValueError(f"unknown mode {mode}")
    if allowed is not None:
        chunks = allowlisted(chunks, allowed)
    if limit is not None:
        chunks = first_papers(chunks, limit)
    if present is None or mode not in ("incremental", "recent"):
        return index_from_chunks(chunks)
    return extend(present, chunks) if mode == "incremental" else index_from_chunks(not_yet_present(chunks, present.papers))
