"""Token counts, label normalisation and salted ranks shared by packing and mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_SPACE = r"\p{Z}\t-\r\x1c-\x1f\x85"
#: A run of letters, digits or underscores, or any other single character that is no white space.
TOKEN_PATTERN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]"

#: Rows of one group that one task ranks, about.
RANK_ROWS = 200_000


def token_count(text: Column) -> Column:
    """Tokens of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0)).cast("long")


def label(value: Column) -> Column:
    """A label trimmed of any white space and lower-cased."""
    return F.lower(F.regexp_replace(value, rf"^[{_SPACE}]+|[{_SPACE}]+$", ""))


def salted_rank(rows: DataFrame, group: list[str], order: list[str], n_rows: int, name: str = "rank") -> DataFrame:
    """rows with the rank from 0 within group, by salt and then order, both fixed by the order columns' values.

    A group is ranked in as many parts as rows / RANK_ROWS, so one that holds
    most rows is spread; parts are put one after another by their counts.
    rows is read twice and should be cheap to read.
    """
    parts = max(1, -(-n_rows // RANK_ROWS))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rn", F.row_number().over(within) - 1)
    return ranked.join(offsets, [*group, "_salt"]).withColumn(name, (F.col("_from") + F.col("_rn")).cast("long")).drop("_salt", "_rn", "_from")
