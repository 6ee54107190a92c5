"""Frequency of every distinct term, with terms too rare or too common marked."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscan.operators.skew import clustered_distinct, salted_join
from folioscan.runtime import durable

#: A term with at least this share of all facts is heavy; so there are at most 512 heavy terms.
HEAVY_SHARE = 1 / 512


@F.pandas_udf(StringType())
def normal_form(terms: pd.Series) -> pd.Series:
    """NFC, trimmed of white space, lower-cased; null stays null."""
    return terms.map(lambda t: None if t is None else unicodedata.normalize("NFC", t).strip().lower())


def term_counts(posting: DataFrame, token: DataFrame, rare: int = 2, common: float = 0.15, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(term, chunks, total_tf, band) for every term with postings; band is rare, common or useful.

    Ids of one normalised term are merged, exact repeats of a posting row count
    once, chunks counts distinct chunk ids, and common compares with the
    distinct chunk ids of all postings, also of ids not in token. Null ids and
    null terms count nowhere but for such a row's chunk; a null tf adds 0.
    Postings are shuffled once, by chunk (a hot chunk in parts by term): repeats,
    the ids of one term and the chunks of a term are then all settled in place.
    Heavy terms (a bounded list, by counts of rows) are counted in local arrays,
    of which only the sums move; of all other terms a task sends one partial count each.
    """
    rows = posting.where(F.col("chunk_id").isNotNull()).select("token_id", "chunk_id", F.col("tf").cast("double").alias("tf"))
    one = F.count(F.lit(1)).alias("n")
    by_chunk = durable(rows.groupBy("chunk_id").agg(one), "chunk-rows")
    n_chunks = by_chunk.count()
    by_id = durable(rows.where(F.col("token_id").isNotNull()).groupBy("token_id").agg(one), "token-rows")
    pairs = token.where(F.col("id").isNotNull() & F.col("term").isNotNull()).select("id", "term").distinct()
    named = durable(pairs.select(F.col("id").alias("token_id"), normal_form("term").alias("term")).distinct(), "terms")
    # A term goes by its least id. An id with several terms counts for each.
    codes = durable(named.groupBy("term").agg(F.min("token_id").alias("code")), "term-codes")
    ids = durable(named.join(codes, "term").join(by_id, "token_id").select("token_id", "code", "n"), "term-ids")
    by_code = ids.groupBy("code").agg(F.sum("n").alias("n"))
    every = ids.agg(F.sum("n")).first()[0] or 0
    heavy = np.array(sorted(r["code"] for r in by_code.where(F.col("n") >= F.lit(float(every) * heavy_share)).collect()), dtype=np.int64)

    known = rows.where(F.col("token_id").isNotNull())
    coded = salted_join(known, ids.select("token_id", "code"), "token_id", by_id, measure=True)
    facts = clustered_distinct(coded.select("chunk_id", "code", "token_id", "tf"), "chunk_id", "code", by_chunk)
    in_chunk = facts.groupBy("chunk_id", "_salt", "code").agg(F.coalesce(F.sum("tf"), F.lit(0.0)).alias("tf")).select("code", "tf")

    def count_locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, total = np.zeros(len(heavy), np.int64), np.zeros(len(heavy))
        names = ["code", "chunks", "total_tf"]
        for batch in batches:
            code, tf = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "tf"))
            slot = np.searchsorted(heavy, code)
            dense = slot < len(heavy)
            dense[dense] = heavy[slot[dense]] == code[dense]
            chunks += np.bincount(slot[dense], minlength=len(heavy))
            total += np.bincount(slot[dense], weights=tf[dense], minlength=len(heavy))
            light = code[~dense]
            yield pa.RecordBatch.from_arrays([pa.array(light), pa.array(np.ones(len(light), np.int64)), pa.array(tf[~dense])], names=names)
        used = np.flatnonzero(chunks)
        yield pa.RecordBatch.from_arrays([pa.array(heavy[used]), pa.array(chunks[used]), pa.array(total[used])], names=names)

    counted = in_chunk.mapInArrow(count_locally, "code long, chunks long, total_tf double")
    # Partial sums of light terms are combined in the same stage, as the arrays of heavy ones are.
    sums = counted.groupBy("code").agg(F.sum("chunks").alias("chunks"), F.sum("total_tf").alias("total_tf"))
    band = (
        F.when(F.col("chunks") <= rare, "rare")
        .when(F.col("chunks") >= F.lit(common) * F.lit(float(n_chunks)), "common")
        .otherwise("useful")
    )
    return sums.join(codes, "code").select("term", "chunks", "total_tf", band.alias("band"))
