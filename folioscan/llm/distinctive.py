"""How distinctive a term is for a record: positive pointwise mutual information and normalised weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.operators.skew import clustered_distinct, salted_join
from folioscan.runtime import durable

#: Exponent that smooths the counts of contexts (records), so that short records do not win by their shortness.
CONTEXT_POWER = 0.75


def distinctive_terms(posting: DataFrame, power: float = CONTEXT_POWER) -> DataFrame:
    """(chunk_id, token_id, tf, df, terms, ppmi, weight, share) for every distinct posting row.

    ppmi compares the joint count tf with the marginal counts of the term and
    of the record, the latter raised to power. weight is
    (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), share is weight over the root of
    the sum of squared weights of the record, terms the distinct token ids of the
    record. N and df count distinct chunk ids, and stored counters are not used.
    Rows with a null id count nowhere; a row whose tf is null or not positive
    counts for N, df and terms but has no weight and no row. Postings are shuffled
    once by chunk (a hot chunk in parts by token), where repeats drop out and the
    rows of a pair are told apart; what follows are aggregations with map-side
    combine and equi-joins in which hot tokens and hot chunks are spread.
    """
    rows = posting.where(F.col("token_id").isNotNull() & F.col("chunk_id").isNotNull()).select("token_id", "chunk_id", F.col("tf").cast("double").alias("tf"))
    one = F.count(F.lit(1)).alias("n")
    by_chunk = durable(rows.groupBy("chunk_id").agg(one), "chunk-rows")
    n_chunks = by_chunk.count()
    pair = Window.partitionBy("chunk_id", "_salt", "token_id").orderBy("tf")
    once = clustered_distinct(rows, "chunk_id", "token_id", by_chunk).withColumn("first", (F.row_number().over(pair) == 1).cast("int"))
    facts = durable(once.drop("_salt"), "weight-facts")
    usable = F.when(F.col("tf") > 0, F.col("tf"))
    terms = durable(facts.groupBy("token_id").agg(F.sum("first").alias("df"), F.sum(usable).alias("term_tf"), one), "weight-terms")
    weight = (1 + F.log("tf")) * (F.log(F.lit(1.0 + n_chunks) / (1 + F.col("df"))) + 1)
    joined = salted_join(facts, terms.select("token_id", "df", "term_tf"), "token_id", terms, measure=True).withColumn("weight", F.when(F.col("tf") > 0, weight))
    records = durable(
        joined.groupBy("chunk_id").agg(
            F.sum("first").alias("terms"), F.sum(usable).alias("chunk_tf"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), one
        ),
        "weight-records",
    )
    sums = records.agg(F.sum("chunk_tf"), F.sum(F.pow("chunk_tf", F.lit(power)))).first()
    total, contexts = float(sums[0] or 1.0), float(sums[1] or 1.0)
    # The logarithm is null where tf gives no weight, so it says which rows come out.
    pmi = F.log((F.col("tf") / total) / ((F.col("term_tf") / total) * (F.pow("chunk_tf", F.lit(power)) / contexts)))
    return (
        salted_join(joined, records.drop("n"), "chunk_id", records, measure=True)
        .withColumn("pmi", pmi)
        .where(F.col("pmi").isNotNull())
        .select(
            "chunk_id",
            "token_id",
            "tf",
            "df",
            "terms",
            F.greatest(F.lit(0.0), F.col("pmi")).alias("ppmi"),
            "weight",
            (F.col("weight") / F.col("norm")).alias("share"),
        )
    )
