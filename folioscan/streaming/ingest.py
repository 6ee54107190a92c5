"""Incremental ingest of arriving chunk records as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.operators.ingest import not_yet_present
from folioscan.runtime import exists
from folioscan.sources.records import CHUNK_SCHEMA

RECORD_SCHEMA = "arxiv_id string, " + CHUNK_SCHEMA


def read_arrivals(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of chunk records from JSON files that arrive under path."""
    return spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(arrivals: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append the records of papers that store lacks, micro-batch by micro-batch, to the table at store.

    A batch's papers are compared with those of earlier batches only, so that
    all files of a paper in one batch count. A batch that is run again after a
    failure first replaces what it had written, as each has its own folder.
    df and norms change with every batch and are counted when an index is built of the table.
    """
    spark = arrivals.sparkSession
    ids = f"{store.rstrip('/')}-papers"

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where("arxiv_id is not null and id is not null").dropDuplicates(["arxiv_id", "id"])
        if exists(spark, ids):
            rows = not_yet_present(rows, spark.read.schema("arxiv_id string, batch long").parquet(ids).where(F.col("batch") < batch_id))
        rows.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
        # The papers of a batch are kept apart, so that later ones need not read its records.
        spark.read.parquet(f"{store}/batch={batch_id}").select("arxiv_id").distinct().write.mode("overwrite").parquet(f"{ids}/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
