"""Near-duplicate records by a size-aware set similarity join over word shingles."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.operators import skew
from folioscan.operators.skew import hot_keys, met_in_blocks, salted_join
from folioscan.runtime import durable

#: Tokens in an enumerated subset of a small set.
SUBSET = 2
#: Of so many sets one is looked at for shingles that very many sets hold.
SAMPLE = 16


def words(text: Column) -> Column:
    """Maximal runs of letters or digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, k: int, min_words: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per usable record: (id, keep..., sig, size, shingles), shingles sorted 64-bit hashes of k-word runs.

    Records with a null id or text, fewer than min_words words or fewer than k
    words have no row. A repeated id is taken once, with its least kept values.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), *keep, words(F.col(text_col)).alias("w")
    )
    rows = rows.where(F.size("w") >= max(k, min_words))
    runs = F.transform(
        F.slice("w", F.lit(1), F.size("w") - (k - 1)),
        lambda x, i: F.xxhash64(x, *[F.element_at(F.col("w"), i + 1 + j) for j in range(1, k)]),
    )
    rows = rows.select("id", *keep, F.array_sort(F.array_distinct(runs)).alias("shingles"))
    # Two hashes of the whole set make its 128-bit signature.
    rows = rows.withColumn("sig", F.concat_ws("-", F.xxhash64("shingles"), F.xxhash64(F.lit(k), "shingles")))
    return rows.select("id", *keep, "sig", F.size("shingles").alias("size"), "shingles")


def _needed(size: Column, threshold: float) -> Column:
    """Tokens that a set of this size shares with any set of at least that similarity."""
    return F.ceil(size * F.lit(threshold) - 1e-9).cast("int")


def _boundary(sets: DataFrame) -> int:
    """The largest size to be enumerated, by cost.

    Costs are summed by size class (four to a doubling, so a few hundred rows
    however large the collection): a small set costs its subsets, a large one
    the inverted lists of its prefix.
    """
    m = F.least("n2", F.lit(60_000)).cast("double")
    by_size = (
        sets.groupBy(F.floor(4 * F.log2("size")).alias("c"))
        .agg(F.max("size").alias("top"), F.sum(m * (m - 1) / 2).alias("subsets"), F.sum("scan").alias("lists"), F.sum("n1").alias("entries"))
        .orderBy("c")
        .collect()
    )
    scan = sum(r["lists"] for r in by_size)
    entries = float(sum(r["entries"] for r in by_size))
    best, at, small = scan + entries, 0, 0.0
    for r in by_size:
        small += 2 * r["subsets"]
        scan -= r["lists"]
        cost = small + scan + (entries if scan > 0 else 0.0)
        if cost < best:
            best, at = cost, r["top"]
    return at


def _with_counts(sets: DataFrame) -> DataFrame:
    """(id, size, h, df) for every shingle that more than one set holds, df the number of these sets.

    Shingles are shuffled once, by themselves, and counted where they meet. Those
    that very many sets hold, found on a sample of the sets by a hash of the id,
    are kept out of that: they are counted with partial sums and the counts
    sent to them. All counts are exact; the sample only says which way a shingle goes.
    """
    tokens = sets.select("id", "size", F.explode("shingles").alias("h"))
    part = 1.0 / SAMPLE
    drawn = sets.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select(F.explode("shingles").alias("h"))
    hot = hot_keys(drawn.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "h", hot_rows=max(1, int(skew.HOT_ROWS * part / 2)))
    listed = hot.select("h").collect()
    here = F.count(F.lit(1)).over(Window.partitionBy("h"))
    if not listed:
        return tokens.withColumn("df", here).where("df > 1")
    hot = F.broadcast(sets.sparkSession.createDataFrame(listed, "h long"))
    many = tokens.join(hot, "h", "left_semi").select("id", "size", "h")
    counts = many.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # At most HOT_KEYS counts of two numbers.
    known = many.join(F.broadcast(counts), "h").select("id", "size", "h", "df")
    return tokens.join(hot, "h", "left_anti").select("id", "size", "h").withColumn("df", here).unionByName(known).where("df > 1")


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, common, size_a, size_b), a < b, of distinct shingle sets with Jaccard similarity of at least threshold.

    sets has (id, size, shingles), ids unique. Tokens are ordered by rarity.
    Two similar sets share at least two tokens of their two-prefixes and one of
    their one-prefixes. Sets up to a boundary enumerate the two-token subsets
    of their two-prefix and meet on equal subsets; for a pair with a larger set
    the larger side's one-prefix scans the inverted lists of all one-prefixes.
    The boundary is the size of least total cost. Tokens of one set only can't
    match and take prefix places without being emitted. Pairs are then verified
    exactly. Nothing is capped: a token, subset or set that very many others meet
    is cut by its counted rows into blocks, which meet each other in tasks of their own.
    """
    need = _needed(F.col("size"), threshold)
    rare = F.col("size") - F.size("shared")
    ranked = (
        _with_counts(sets)
        .groupBy("id")
        .agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("shared"))
        .withColumn("need", need)
        .withColumn("n1", F.greatest(F.lit(0), F.least(F.size("shared"), F.col("size") - F.col("need") + 1 - rare)))
        .withColumn("n2", F.greatest(F.lit(0), F.least(F.size("shared"), F.col("size") - F.col("need") + SUBSET - rare)))
        .where("n2 > 0")
    )
    # shared holds the hashes by rarity; the prefixes are its first n1 and n2.
    scan = F.aggregate(F.slice("shared.df", F.lit(1), F.col("n1")), F.lit(0.0), lambda a, x: a + x)
    ranked = durable(ranked.select("id", "size", "need", "n1", "n2", scan.alias("scan"), F.col("shared.h").alias("shared")), "ranked-sets")
    limit = _boundary(ranked)
    is_small = (F.col("size") <= limit) & (F.col("need") >= SUBSET)

    # Within a set both tokens of a subset are listed in the global order, so equal subsets hash alike.
    pairs_of = F.flatten(F.transform("pre", lambda x, i: F.transform(F.slice("pre", i + 2, F.size("pre")), lambda y: F.xxhash64(x, y))))
    small = ranked.where(is_small).select("id", "size", F.slice("shared", F.lit(1), F.col("n2")).alias("pre"))
    subsets = small.select(F.explode(pairs_of).alias("key"), "id", "size")
    lists = ranked.select(F.explode(F.slice("shared", F.lit(1), F.col("n1"))).alias("key"), "id", "size", (~is_small).alias("large"))

    def met(left: DataFrame, right: DataFrame, extra: Column) -> DataFrame:
        left, right = met_in_blocks(left, right, "key", "id")
        x, y = left.alias("x"), right.alias("y")
        fits = F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * F.lit(threshold) - 1e-9
        place = (F.col("x.key") == F.col("y.key")) & (F.col("x._i") == F.col("y._i")) & (F.col("x._j") == F.col("y._j"))
        return x.join(y, place & fits & extra).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    found = met(subsets, subsets, F.col("x.id") < F.col("y.id")).distinct()
    scans = lists.where("large")
    if not scans.isEmpty():
        one_way = (F.col("x.id") < F.col("y.id")) | ((F.col("x.id") > F.col("y.id")) & ~F.col("y.large"))
        found = found.unionByName(met(scans, lists, one_way)).distinct()
    found = durable(found, "candidate-pairs")

    def with_set(pairs: DataFrame, side: str) -> DataFrame:
        """pairs with the set of one side, which is sent to several tasks if many pairs have it."""
        own = ranked.select(F.col("id").alias(side), F.col("size").alias(f"size_{side}"), F.col("shared").alias(f"shared_{side}"))
        return salted_join(pairs, own, side, found.groupBy(side).agg(F.count(F.lit(1)).alias("n")))

    checked = with_set(with_set(found, "a"), "b").select("a", "b", "size_a", "size_b", F.size(F.array_intersect("shared_a", "shared_b")).alias("common"))
    return checked.where(F.col("common") >= F.lit(threshold) * (F.col("size_a") + F.col("size_b") - F.col("common")) - 1e-9)


class NearDuplicates:
    """Members, classes of equal shingle sets and links between classes of a collection.

    members: (id, keep..., rep), one row per usable record; rep is the least id
    with the same shingle set. links: (a, b, common, size_a, size_b) between
    representatives, a < b. Copies are linked through their rep and never
    expanded into pairs here.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int = 5, threshold: float = 0.8, min_words: int = 0, keep: tuple[str, ...] = ()):
        self.keep = keep
        sets = durable(shingle_sets(docs, id_col, text_col, k, min_words, keep), "shingle-sets")
        slim = sets.groupBy("id").agg(F.min(F.struct("sig", *keep)).alias("m")).select("id", "m.*")
        reps = slim.groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        many = reps.select("sig", F.col("copies").alias("n"))
        self.members = durable(salted_join(slim, reps, "sig", many).select("id", *keep, "rep", "sig", "copies"), "duplicate-members")
        # Sets are shuffled once, by id alone; the signature is compared after.
        chosen = self.members.where("id = rep").select("id", F.col("sig").alias("_sig"))
        classes = sets.select("id", "sig", "size", "shingles").join(chosen, "id").where("sig between _sig and _sig")
        classes = classes.dropDuplicates(["id"]).select("id", "size", "shingles")
        self.links = similar_sets(classes, threshold)

    def pairs(self, different: str | None = None) -> DataFrame:
        """All similar pairs (a, b), a < b, of records; with different, only where that kept column differs (null never does).

        Sets of very many copies meet in blocks of members, so no task makes all
        pairs of one set. classes() has the same in one row a record.
        """
        cols = [different] if different else []
        members = self.members.select("id", "rep", *[F.col(c).alias("d") for c in cols])
        test = (F.col("l.d") != F.col("r.d")) if cols else F.lit(True)
        out = [F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")]
        links = durable(self.links.select("a", "b"), "duplicate-links")
        # Each record is asked under its own set and every set linked to it, and meets the members of that set.
        sizes = self.members.where("id = rep").select("rep", F.col("copies").alias("n"))
        out_of = links.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        sent = salted_join(links.withColumnRenamed("a", "rep"), members, "rep", out_of.join(sizes.withColumnRenamed("n", "m"), F.col("a") == F.col("rep")).select("rep", F.greatest("n", "m").alias("n")))
        copied = self.members.where("copies > 1").select("id", F.col("rep").alias("to"), *[F.col(c).alias("d") for c in cols], F.lit(True).alias("same"))
        asks = sent.select("id", F.col("b").alias("to"), *(["d"] if cols else []), F.lit(False).alias("same")).unionByName(copied)
        left, right = met_in_blocks(asks, members.withColumnRenamed("rep", "to"), "to", "id")
        once = ~F.col("l.same") | (F.col("l.id") < F.col("r.id"))
        return left.alias("l").join(right.alias("r"), ["to", "_i", "_j"]).where(once & test).select(*out)

    def classes(self) -> DataFrame:
        """One row per record: (id, class_id, links).

        class_id is the least id of the connected set of similar records and
        links the number of other records it is similar to, its copies included.
        """
        links = durable(self.links.select("a", "b"), "duplicate-links")
        sizes = self.members.where("id = rep").select(F.col("id").alias("b"), "copies")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met = both.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        linked = salted_join(both, sizes, "b", met).groupBy("a").agg(F.sum("copies").alias("linked")).withColumnRenamed("a", "rep")
        labels = components(links).withColumnRenamed("node", "rep")
        # One row a set, sent to the members.
        facts = labels.join(linked, "rep", "full")
        many = self.members.where("id = rep").select("rep", F.col("copies").alias("n"))
        return (
            salted_join(self.members.select("id", "rep", "copies"), facts, "rep", many, "left")
            .select(
                "id",
                F.coalesce("component", "rep").alias("class_id"),
                (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"),
            )
        )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the least node reached.

    Alternates large-star and small-star steps until the edges no longer
    change; the driver sees only counts.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "large-star")
        large = salted_join(both.where("v > u"), least.drop("n"), "u", least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = durable(large, "large-star-edges")
        least = durable(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "small-star")
        small = salted_join(large, least.drop("n"), "u", least).select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        edges = durable(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = nodes.select(F.col("component").alias("node"), "component").distinct()
    return nodes.unionByName(roots)


def brute_force_pairs(sets: dict[int, frozenset], threshold: float) -> set[tuple[int, int]]:
    """All similar pairs of a small fixture, by comparing all with all; for tests."""
    return {
        (a, b)
        for a, b in combinations(sorted(sets), 2)
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9
    }
