import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.operators.skew import clustered_distinct, heavy_keys, hot_keys, key_quantiles, key_statistics, met_in_blocks, salted_join

SCHEMA = "token_id long, chunk_id long, tf double"


def test_statistics_of_hot_keys_with_repeats_and_nulls(spark):
    rows = [(1, c, float(c % 3)) for c in range(300)] * 2 + [(2, 7, 1.0), (2, 7, 2.0), (2, 7, None), (None, 7, 4.0), (3, None, 5.0), (4, 8, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as rows", "2 as key_id", "3 as n")
    got = {(r.key_field, r.key_id): (r.rows, r.partners, r.total) for r in key_statistics(df, "token_id", "chunk_id", "tf").collect()}
    assert got["token_id", 1] == (600, 300, 300.0)
    assert got["token_id", 2] == (3, 1, 3.0)
    assert got["token_id", 3] == (1, 0, 5.0) and got["token_id", 4] == (1, 1, 0.0)
    assert got["chunk_id", 7] == (6, 2, 8.0)
    assert ("token_id", None) not in got and ("chunk_id", None) not in got
    stats = key_statistics(df, "token_id", "chunk_id", "tf")
    heavy = heavy_keys(stats, F.lit(float(len(rows))), {"token_id": 0.5}, {"chunk_id": 6}).collect()
    assert {(r.key_field, r.key_id) for r in heavy} == {("token_id", 1), ("chunk_id", 7)}
    assert key_statistics(df.where("false"), "token_id", "chunk_id", "tf").count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    values = {1: rng.normal(size=400) * 1e6, 2: rng.integers(0, 4, 500).astype(float), 3: np.array([5.0]), 4: np.array([1e16, 1e16 + 2, 1e16 + 4, -1e300]), 5: 10.0 ** rng.uniform(-300, 300, 100), 9: -(10.0 ** rng.uniform(-9, 9, 50))}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(6, None), (None, 1.0), (7, float("nan")), (8, float("inf")), (8, 1.0)]
    df = spark.createDataFrame(rows, "k long, v double").selectExpr("*", "k + 100 as other", "1 as n", "2 as lo", "3 as f", "4 as c", "5 as key_id")
    fractions = (0.0, 0.25, 0.5, 1.0)
    got = {(r.key_field, r.key_id, r.fraction): (r.rows, r.n, r.quantile) for r in key_quantiles(df, ("k", "other"), "v", fractions, bins=16).collect()}
    for k, vs in values.items():
        for f in fractions:
            want = (len(vs), len(vs), sorted(vs)[max(1, math.ceil(f * len(vs))) - 1])
            assert got["k", k, f] == want and got["other", k + 100, f] == want
    assert {k for field, k, _ in got if field == "k"} == set(range(1, 10))
    assert got["k", 8, 0.5] == (2, 2, 1.0) and got["k", 6, 0.5] == (1, 0, None) and got["k", 7, 0.5] == (1, 0, None)
    some = key_quantiles(df, ("k",), "v", (0.5,), least=lambda p: p.where("rows >= 400")).collect()
    assert {r.key_id for r in some} == {1, 2}
    assert key_quantiles(df.where("false"), ("k",), "v", (0.5,)).count() == 0


def hot_rows(spark, n=200_000):
    """Half of all rows on one key, the rest on keys of their own."""
    return spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))


@pytest.fixture
def apart(spark):
    """Partitions as they are shuffled."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_key_is_spread_over_tasks(spark, apart):
    rows = hot_rows(spark)
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    lookup = rows.select("k").distinct().withColumn("y", F.col("k") * 2)
    for hot, least, most in ((1_000, 0, 80_000), (1_000_000, 100_000, 200_000)):
        joined = salted_join(rows, lookup, "k", counts, hot_rows=hot).withColumn("p", F.spark_partition_id())
        most_in_task = joined.groupBy("p").count().agg(F.max("count")).first()[0]
        assert least < most_in_task <= most
        assert joined.count() == 200_000 and joined.where("y <> k * 2").count() == 0
    some = lookup.where("k < 100")
    assert salted_join(rows, some, "k", counts, "left_semi", hot_rows=1_000).count() == 100_050
    assert salted_join(rows, some, "k", counts, "left_anti", hot_rows=1_000).count() == 99_950
    assert salted_join(rows, some, "k", counts, "left", hot_rows=1_000).where("y is null").count() == 99_950
    assert hot_keys(counts, "k", hot_rows=1_000).collect() == [(-1, 100)]


def test_pairs_of_a_hot_key_meet_once_and_apart(spark, apart):
    rows = spark.range(3_000).select(F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.floor(F.col("id") / 6)).alias("k"), F.col("id").alias("x")).unionByName(spark.createDataFrame([(None, 9)], "k long, x long"))
    a, b = rows.withColumn("id", F.col("x")), rows.select("k", F.col("x").alias("id"))
    left, right = met_in_blocks(a, b, "k", "id", 100)
    pairs = left.alias("l").join(right.alias("r"), ["k", "_i", "_j"]).select("k", F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    assert pairs.count() == pairs.distinct().count() == 1_500**2 + 500 * 9
    most = pairs.where("k = -1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 1_500**2 * 0.6
    assert left.where("_i > 0 and k >= 0").count() == 0
    left, right = met_in_blocks(a, a, "k", "id", 100)
    assert left.join(right, ["k", "_i", "_j"]).count() == 1_500**2 + 500 * 9
    plain, _ = met_in_blocks(a, a, "k", "id", 10_000)
    assert plain.agg(F.max("_i"), F.max("_j"), F.count(F.lit(1))).first() == (0, 0, 3_001)


def test_distinct_rows_of_a_hot_key_are_spread(spark, apart):
    rows = hot_rows(spark).unionByName(hot_rows(spark)).unionByName(spark.createDataFrame([(None, 1), (None, 1)], "k long, x long"))
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    for hot in (1_000, 1_000_000):
        once = clustered_distinct(rows, "k", "x", counts, hot_rows=hot)
        assert once.count() == 200_001 and once.select("k", "x").distinct().count() == 200_001
        most = once.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert (most < 80_000) == (hot == 1_000)
