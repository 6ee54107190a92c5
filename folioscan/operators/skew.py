"""Per-key statistics and exact per-key quantiles when a few keys hold most rows."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.runtime import broadcast_if_small, durable

#: A key with more rows than this is spread over several tasks, and the keys, at most, that are.
HOT_ROWS = 100_000
HOT_KEYS = 4_096
#: Rows of one key that one task compares with as many others.
BLOCK_ROWS = 4_000


def hot_keys(counts: DataFrame, key: str, count: str = "n", hot_rows: int | None = None) -> DataFrame:
    """(key, salts): the HOT_KEYS keys of most rows among those with over hot_rows rows, and the parts each is cut into.

    counts has one row a key. The list is bounded, so it can be broadcast; a key
    that it leaves out holds less than one row in HOT_KEYS.
    """
    most = hot_rows or HOT_ROWS
    top = counts.where(F.col(key).isNotNull() & (F.col(count) > most)).orderBy(F.col(count).desc(), key).limit(HOT_KEYS)
    return top.select(key, F.ceil(F.col(count) / most).cast("int").alias("salts"))


def salted_join(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, how: str = "inner", count: str = "n", hot_rows: int | None = None, measure: bool = False) -> DataFrame:
    """rows joined with lookup on key, where a hot key's rows are spread over tasks and its lookup rows repeated for each.

    counts (key, count) says how many rows a key has; it may leave out keys with
    few. how is inner, left, left_semi or left_anti. The spread follows a hash of
    the whole row, so exact repeats stay together. Without a hot key the join is as usual.
    With measure, a lookup (cheap to count) that is small enough is broadcast instead.
    """
    small = broadcast_if_small(lookup) if measure else lookup
    if small is not lookup:
        return rows.join(small, key, how)
    hot = hot_keys(counts, key, count, hot_rows)
    listed = hot.collect()
    if not listed:
        return rows.join(lookup, key, how)
    salts = F.broadcast(rows.sparkSession.createDataFrame(listed, hot.schema))
    spot = F.pmod(F.xxhash64(*rows.columns), F.coalesce(F.col("salts"), F.lit(1))).cast("int")
    left = rows.join(salts, key, "left").withColumn("_salt", spot).drop("salts")
    right = lookup.join(salts, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def clustered_distinct(rows: DataFrame, key: str, spread: str, counts: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """The distinct rows, with _salt, after one shuffle by key; what is grouped by key and _salt, and more, then needs no other.

    A hot key of counts (key, n) is cut into parts by a hash of spread, and its
    repeats are first dropped where they are. Rows with a null key stay together.
    """
    hot = hot_keys(counts, key, hot_rows=hot_rows)
    listed = hot.collect()
    if not listed:
        return rows.repartition(key).distinct().withColumn("_salt", F.lit(0))
    tagged = rows.join(F.broadcast(rows.sparkSession.createDataFrame(listed, hot.schema)), key, "left")
    salt = F.pmod(F.xxhash64(spread), F.coalesce("salts", F.lit(1))).cast("int")
    calm, busy = tagged.where("salts is null"), tagged.where("salts is not null").distinct()
    return calm.unionByName(busy).withColumn("_salt", salt).drop("salts").repartition(key, "_salt").distinct()


def met_in_blocks(left: DataFrame, right: DataFrame, key: str, by: str, block_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """left and right with two columns more, _i and _j, to be joined on key, _i and _j so that each pair of rows of one key meets once.

    A key with more than block_rows rows on a side is cut there into blocks by a
    hash of by; every block of the left meets every block of the right in a place
    of its own. Keys with no more rows have one block on each side. Counting is
    combined map-side; only the keys with several blocks are looked up.
    """
    most = block_rows or BLOCK_ROWS
    if left is right:
        each = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.col("n"))
    else:
        sides = left.select(key, F.lit(1).alias("n"), F.lit(0).alias("m")).unionByName(right.select(key, F.lit(0).alias("n"), F.lit(1).alias("m")))
        each = sides.groupBy(key).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    each = durable(each.where((F.col("n") > most) | (F.col("m") > most)), "blocked-keys")
    if each.isEmpty():
        return tuple(df.withColumns({"_i": F.lit(0), "_j": F.lit(0)}) for df in (left, right))
    many = [F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int").alias(t) for c, t in (("n", "rows_i"), ("m", "rows_j"))]
    blocks = each.select(key, *many)

    def with_blocks(df: DataFrame, count: str, own: str, across: str, at: str, to: str) -> DataFrame:
        known = salted_join(df, blocks, key, each, "left", count)
        mine = F.pmod(F.xxhash64(by), F.coalesce(own, F.lit(1))).cast("int")
        meets = F.explode(F.sequence(F.lit(0), F.coalesce(across, F.lit(1)) - 1))
        return known.withColumn(at, mine).withColumn(to, meets).drop("rows_i", "rows_j")

    return with_blocks(left, "n", "rows_i", "rows_j", "_i", "_j"), with_blocks(right, "m", "rows_j", "rows_i", "_j", "_i")


def key_statistics(rows: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """Statistics of both key columns of a fact table: (key_field, key_id, rows, partners, total).

    rows counts every row, partners the distinct ids on the other side and
    total the sum of value with exact repeats counted once. Repeats collapse in
    a first aggregation keyed by the whole row, which spreads a hot key over all
    tasks; later steps combine map-side, so a task sends one partial row a key.
    Null keys belong to no key and null partners count as no partner; a null
    value adds nothing, and a key without any value has total 0. An empty table
    gives no rows. Other columns are ignored.
    """
    facts = (
        rows.select(F.col(left).alias("l"), F.col(right).alias("r"), F.col(value).cast("double").alias("v"))
        .groupBy("l", "r", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    pairs = facts.groupBy("l", "r").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    keyed = pairs.select(
        F.explode(
            F.array(
                F.struct(F.lit(left).alias("key_field"), F.col("l").alias("key_id"), F.col("r").alias("partner")),
                F.struct(F.lit(right).alias("key_field"), F.col("r").alias("key_id"), F.col("l").alias("partner")),
            )
        ).alias("k"),
        "n",
        "v",
    )
    return (
        keyed.select("k.*", "n", "v")
        .where(F.col("key_id").isNotNull())
        .groupBy("key_field", "key_id")
        .agg(
            F.sum("n").alias("rows"),
            F.count("partner").alias("partners"),
            F.coalesce(F.sum("v"), F.lit(0.0)).alias("total"),
        )
    )


def heavy_keys(stats: DataFrame, total_rows: Column, shares: dict[str, float], counts: dict[str, int]) -> DataFrame:
    """Keys of stats with at least a share of all rows, or at least a number of rows, by key field."""
    tests = [(F.col("key_field") == k) & (F.col("rows") >= F.lit(s) * total_rows) for k, s in shares.items()]
    tests += [(F.col("key_field") == k) & (F.col("rows") >= c) for k, c in counts.items()]
    return stats.where(reduce(lambda a, b: a | b, tests, F.lit(False)))


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of v in [lo, hi], never falling with v; lo and hi are in the first and the last one.

    An interval across zero is cut by sign, a wide one of one sign in equal
    ratios, any other in equal steps, so a few rounds resolve values of any spread.
    """
    up, down = (lo > 0) & (hi / 4 > lo), (hi < 0) & (lo / 4 < hi)

    def scaled(x: Column) -> Column:
        return F.when(up, F.log(x)).when(down, -F.log(-x)).otherwise(x)

    step = scaled(hi) / bins - scaled(lo) / bins
    spot = F.floor(scaled(v) / step - scaled(lo) / step).cast("long")
    return (
        F.when(v == lo, F.lit(0))
        .when(v == hi, F.lit(bins - 1))
        .when((lo <= 0) & (hi >= 0), F.signum(v) + 1)
        .otherwise(F.greatest(F.lit(0), F.least(F.lit(bins - 1), spot)))
        .cast("int")
    )


def key_rows(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """(key_field, key_id, v, c): how often each value (null too) comes with each id of the key columns, all of one type.

    Equal rows are added up map-side before anything moves, and the shuffle is by
    key and value, so a hot key is spread by its values.
    """
    most = sys.float_info.max
    v = F.col(value).cast("double")
    v = F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.lit(-most), F.least(F.lit(most), v)))
    parts = [F.struct(F.lit(k).alias("key_field"), F.col(k).alias("key_id")) for k in keys]
    named = rows.select(F.explode(F.array(*parts)).alias("k"), v.alias("v")).select("k.*", "v")
    return named.where(F.col("key_id").isNotNull()).groupBy("key_field", "key_id", "v").agg(F.count(F.lit(1)).alias("c"))


def key_quantiles(
    rows: DataFrame, keys: tuple[str, ...], value: str, fractions: tuple[float, ...], bins: int = 256, max_rounds: int = 64,
    least: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Exact quantiles of value for every id of the key columns: (key_field, key_id, fraction, rows, n, quantile).

    rows counts all rows of the key, n those with a value. The quantile of
    fraction f is the value of rank ceil(f * n), 1 at least, null if n is 0. The
    first histogram is the number of rows and the range of each key; least, given
    it as (key_field, key_id, rows, n, lo, hi), may keep some keys only. Each further
    round counts the values of the intervals that still hold a wanted rank in
    bins (mergeable counts, combined map-side), keeps the bin with the rank and
    ends for a key once that bin holds one distinct value. No value of a hot key
    is gathered, and a hot key's rows meet its intervals in several tasks. Null
    keys belong to no key; NaN is no value; infinite values count as the largest
    finite number of their sign. Repeated rows count each time.
    """
    data = durable(key_rows(rows, keys, value), "key-values")
    has = F.col("v").isNotNull()
    profile = data.groupBy("key_field", "key_id").agg(
        F.sum("c").alias("rows"), F.sum(F.when(has, F.col("c")).otherwise(0)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("values")
    )
    profile = durable(least(profile) if least else profile, "key-profile")
    wanted = profile.withColumn("f", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    wanted = wanted.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("f") * F.col("n"))).cast("long"))
    out = ["key_field", "key_id", F.col("f").alias("fraction"), "rows", "n", F.col("lo").alias("quantile")]
    done = [wanted.where("lo is null or lo = hi").select(*out)]
    open_ = wanted.where("lo < hi")
    places = profile.select(F.struct("key_field", "key_id").alias("k"), F.col("values").alias("n"))
    held = data.where(has).select(F.struct("key_field", "key_id").alias("k"), "v", "c")
    for _ in range(max_rounds):
        if open_.isEmpty():
            break
        asked = open_.groupBy(F.struct("key_field", "key_id").alias("k")).agg(F.collect_list(F.struct("f", "rows", "n", "rank", "lo", "hi")).alias("q"))
        met = salted_join(held, durable(asked, "quantile-intervals"), "k", places, measure=True)
        inside = met.withColumn("q", F.explode(F.filter("q", lambda x: F.col("v").between(x["lo"], x["hi"]))))
        inside = inside.select("k.*", "q.f", "q.rows", "q.n", "q.rank", "v", "c", _bin(F.col("v"), F.col("q.lo"), F.col("q.hi"), bins).alias("b"))
        hist = inside.groupBy("key_field", "key_id", "f", "rows", "n", "rank", "b").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("key_field", "key_id", "f").orderBy("b"))
        hit = (
            hist.withColumn("upto", upto)
            .where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
            .withColumn("rank", F.col("rank") - (F.col("upto") - F.col("c")))
        )
        hit = durable(hit.select("key_field", "key_id", "f", "rows", "n", "rank", "lo", "hi"), "quantile-round")
        done.append(hit.where("lo = hi").select(*out))
        open_ = hit.where("lo < hi")
    else:
        if not open_.isEmpty():
            raise RuntimeError("quantile intervals did not close; raise max_rounds")
    return reduce(DataFrame.unionByName, done)
