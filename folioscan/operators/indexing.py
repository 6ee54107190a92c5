"""The inverted index: building it from chunks or from stored tables, storing and versioning it, and features over it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import text as T
from folioscan.operators.skew import salted_join
from folioscan.runtime import _file_system, broadcast_if_small, durable


def idf(n_chunks: Column | int, df: Column) -> Column:
    """ln((1 + N) / (1 + df)) + 1."""
    n = F.lit(float(n_chunks)) if isinstance(n_chunks, (int, float)) else n_chunks
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


@dataclass
class Index:
    """Four tables and two numbers.

    tokens (token_id, term, df), papers (paper_id, arxiv_id, title, year, path),
    chunks (chunk_id, paper_id, kind, text, norm, dl), postings (token_id,
    chunk_id, tf, dl, part). n_chunks counts chunks that bear tokens, avgdl is
    their mean sum of tf. Postings carry their chunk's length, so that they can be
    scored as they are read, and lie in parts folders by a hash of the token,
    sorted by token: a query reads its tokens' folders only.
    """

    tokens: DataFrame
    papers: DataFrame
    chunks: DataFrame
    postings: DataFrame
    n_chunks: int
    avgdl: float
    parts: int = 1
    tables: tuple[str, ...] = field(default=("tokens", "papers", "chunks", "postings"), repr=False)

    def save(self, path: str) -> None:
        """Write the four tables and the numbers under path, postings in files ranged by token."""
        spark = self.postings.sparkSession
        self.tokens.write.parquet(f"{path}/tokens")
        self.papers.write.parquet(f"{path}/papers")
        self.chunks.write.parquet(f"{path}/chunks")
        _laid_out(self.postings, self.parts).write.partitionBy("part").parquet(f"{path}/postings")
        spark.createDataFrame([(self.n_chunks, self.avgdl, self.parts)], "n_chunks long, avgdl double, parts int").coalesce(1).write.parquet(f"{path}/stats")

    def postings_of(self, token_ids: list[int] | None) -> DataFrame:
        """Postings of the given tokens; of all if None. Folders of other tokens are not read, nor row groups of other ranges."""
        if token_ids is None:
            return self.postings
        spark = self.postings.sparkSession
        ids = spark.createDataFrame([(t,) for t in token_ids], "t long")
        parts = [r[0] for r in ids.select(_part(F.col("t"), self.parts)).distinct().collect()]
        return self.postings.where(F.col("part").isin(parts) & F.col("token_id").isin(token_ids))

    def register(self, prefix: str = "") -> None:
        """Temporary views of the four tables for SQL."""
        for name in self.tables:
            getattr(self, name).createOrReplaceTempView(prefix + name)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        n, avgdl, parts = spark.read.parquet(f"{path}/stats").first()
        read = {t: spark.read.parquet(f"{path}/{t}") for t in ("tokens", "papers", "chunks", "postings")}
        return cls(read["tokens"], read["papers"], read["chunks"], read["postings"], n, avgdl, parts)


#: Postings of one folder, about, and the most folders.
PART_ROWS = 2_000_000
MOST_PARTS = 1_024


def _part(token_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(token_id), F.lit(parts)).cast("int")


def _laid_out(postings: DataFrame, parts: int) -> DataFrame:
    """postings with part, in files of one part each; a part that one token fills is split over tasks."""
    rows = postings.withColumn("part", _part(F.col("token_id"), parts))
    return rows.hint("rebalance", "part").sortWithinPartitions("part", "token_id", "chunk_id")


def _finish(tokens: DataFrame, papers: DataFrame, chunks: DataFrame, postings: DataFrame) -> Index:
    """Document frequencies, norms and lengths over clean tables; chunks without postings drop out."""
    df = durable(postings.groupBy("token_id").agg(F.count(F.lit(1)).alias("df")), "token-df")
    tokens = durable(tokens.join(df, "token_id", "left").select("token_id", "term", F.coalesce("df", F.lit(0)).cast("long").alias("df")), "tokens")
    lengths = durable(postings.groupBy("chunk_id").agg(F.sum("tf").alias("dl"), F.count(F.lit(1)).alias("n")), "lengths")
    n, total, rows = lengths.agg(F.count(F.lit(1)), F.sum("dl"), F.sum("n")).first()
    weight = (1 + F.log("tf")) * idf(n, F.col("df"))
    weighted = salted_join(postings, df, "token_id", df, count="df", measure=True)
    norms = weighted.groupBy("chunk_id").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    measured = norms.join(lengths.drop("n"), "chunk_id").withColumn("norm", F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0))
    chunks = durable(chunks.join(measured, "chunk_id").select("chunk_id", "paper_id", "kind", "text", "norm", "dl"), "chunks")
    parts = max(1, min(MOST_PARTS, -(-(rows or 0) // PART_ROWS)))
    stored = salted_join(postings, lengths.select("chunk_id", "dl"), "chunk_id", lengths, measure=True)
    laid = durable(_laid_out(stored.select("token_id", "chunk_id", "tf", "dl"), parts), "postings", "part")
    return Index(tokens, papers, chunks, laid, int(n), float(total or 0.0) / max(1, n), parts)


def unique_papers(paper: DataFrame) -> DataFrame:
    """(paper_id, arxiv_id, title, year, path), one row per id: of repeated rows the latest to arrive, then the least values."""
    order = [F.col(c).asc_nulls_last() for c in ("arxiv_id", "title", "year", "path")]
    if "ingested_at" in paper.columns:
        order.insert(0, F.col("ingested_at").desc_nulls_last())
    ranked = paper.where("id is not null").withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return ranked.where("_r = 1").select(F.col("id").alias("paper_id"), "arxiv_id", "title", "year", "path")


def unique_chunks(chunk: DataFrame) -> DataFrame:
    """(chunk_id, paper_id, kind, text), one row per id; kind trimmed and lower-cased, the least values of repeated rows."""
    return (
        chunk.where("id is not null")
        .groupBy(F.col("id").alias("chunk_id"))
        .agg(F.min("paper_id").alias("paper_id"), F.min(T.clean_kind(F.col("kind"))).alias("kind"), F.min("text").alias("text"))
    )


def index_from_tables(paper: DataFrame, chunk: DataFrame, token: DataFrame, posting: DataFrame) -> Index:
    """A consistent index of stored tables that repeat rows and whose counters are stale.

    Exact repeats count once, ids of one term become the least of them with
    their tf added, postings of unknown tokens or chunks are left out until
    those arrive, and df, norms and lengths are counted anew. Null ids, null
    terms and tf that is null or not positive are left out.
    """
    named = token.where("id is not null and term is not null").select("id", "term").distinct()
    first = named.groupBy("term").agg(F.min("id").alias("token_id"))
    tokens = durable(first.select("token_id", "term"), "terms")
    ids = durable(named.join(first, "term").select("id", "token_id").distinct(), "term-ids")
    facts = posting.where("token_id is not null and chunk_id is not null and tf > 0").select("token_id", "chunk_id", "tf").distinct()
    facts = durable(facts, "facts")
    chunks = durable(unique_chunks(chunk), "unique-chunks")
    known = broadcast_if_small(chunks.select("chunk_id"))
    per_id = durable(facts.groupBy(F.col("token_id").alias("id")).agg(F.count(F.lit(1)).alias("n")), "token-rows")
    postings = (
        salted_join(facts.withColumnRenamed("token_id", "id"), ids, "id", per_id, measure=True)
        .join(known, "chunk_id", "left_semi")
        .groupBy("token_id", "chunk_id")
        .agg(F.sum("tf").alias("tf"))
    )
    return _finish(tokens, unique_papers(paper), chunks, durable(postings, "postings"))


def index_from_chunks(chunks: DataFrame) -> Index:
    """An index of chunk records (arxiv_id, id, kind, text, tokens).

    Term, paper and chunk ids are ranks in the order of term, arxiv_id and
    (arxiv_id, position in the id, id), so they do not depend on partitioning.
    Exact repeats count once; a record without tokens or ids is not indexed.
    """
    rows = chunks.select("arxiv_id", "id", T.clean_kind(F.col("kind")).alias("kind"), "text", "tokens")
    rows = rows.where(F.col("arxiv_id").isNotNull() & F.col("id").isNotNull() & (F.size("tokens") > 0))
    rows = durable(rows.dropDuplicates(["arxiv_id", "id"]), "chunk-records")
    papers = dense_ids(rows.select("arxiv_id").distinct(), ["arxiv_id"], "paper_id")
    order = [F.col("arxiv_id"), F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("_n"), F.col("id")]
    keys = dense_ids(rows.select(*order), ["arxiv_id", "_n", "id"], "chunk_id").drop("_n")
    body = durable(rows.join(keys, ["arxiv_id", "id"]).join(papers, "arxiv_id"), "numbered-chunks")
    tf = _term_frequencies(body)
    tokens = durable(dense_ids(tf.select("term").distinct(), ["term"], "token_id"), "terms")
    null = F.lit(None)
    papers = papers.select("paper_id", "arxiv_id", null.cast("string").alias("title"), null.cast("int").alias("year"), null.cast("string").alias("path"))
    return _finish(tokens.select("token_id", "term"), papers, body.select("chunk_id", "paper_id", "kind", "text"), _postings(tf, tokens))


def _term_frequencies(body: DataFrame) -> DataFrame:
    terms = body.select("chunk_id", F.explode("tokens").alias("term")).where("term is not null")
    return durable(terms.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).cast("double").alias("tf")), "term-frequencies")


def _postings(tf: DataFrame, tokens: DataFrame) -> DataFrame:
    rows = durable(tf.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-rows")
    named = salted_join(tf, tokens.select("token_id", "term"), "term", rows, measure=True)
    return durable(named.select("token_id", "chunk_id", "tf"), "postings")


def extend(index: Index, chunks: DataFrame) -> Index:
    """index with the chunk records of papers that it lacks: only these are tokenised and numbered, after the ids there are.

    Postings of old chunks are carried over as they are; df, norms and mean
    length are counted anew, since every new chunk changes them. Records are
    taken as in index_from_chunks.
    """
    rows = chunks.select("arxiv_id", "id", T.clean_kind(F.col("kind")).alias("kind"), "text", "tokens")
    rows = rows.where(F.col("arxiv_id").isNotNull() & F.col("id").isNotNull() & (F.size("tokens") > 0))
    fresh = durable(rows.join(index.papers.select("arxiv_id"), "arxiv_id", "left_anti").dropDuplicates(["arxiv_id", "id"]), "fresh-records")
    last = {c: t.agg(F.max(c)).first()[0] or 0 for t, c in ((index.papers, "paper_id"), (index.chunks, "chunk_id"), (index.tokens, "token_id"))}

    def after(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.col(name) + F.lit(last[name]))

    papers = after(dense_ids(fresh.select("arxiv_id").distinct(), ["arxiv_id"], "paper_id"), "paper_id")
    order = [F.col("arxiv_id"), F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("_n"), F.col("id")]
    keys = after(dense_ids(fresh.select(*order), ["arxiv_id", "_n", "id"], "chunk_id").drop("_n"), "chunk_id")
    body = durable(fresh.join(keys, ["arxiv_id", "id"]).join(papers, "arxiv_id"), "numbered-chunks")
    tf = _term_frequencies(body)
    unknown = tf.select("term").distinct().join(index.tokens, "term", "left_anti")
    tokens = index.tokens.select("token_id", "term").unionByName(after(dense_ids(unknown, ["term"], "token_id"), "token_id"))
    tokens = durable(tokens, "terms")
    postings = index.postings.select("token_id", "chunk_id", "tf").unionByName(_postings(tf, tokens))
    every = index.chunks.select("chunk_id", "paper_id", "kind", "text").unionByName(body.select("chunk_id", "paper_id", "kind", "text"))
    return _finish(tokens, index.papers.unionByName(papers, allowMissingColumns=True), every, durable(postings, "postings"))


def dense_ids(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with ids from 1 in the given order, without one task that sorts them all.

    Rows are ranged by the order; each range is numbered within and starts
    after the counts of the ranges before it (one number per range).
    """
    ranged = rows.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id())
    ranged = durable(ranged, "ranged")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return numbered.join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_from") + F.col("_r")).cast("long")).drop("_p", "_r", "_from")


def per_paper_tfidf(chunks: DataFrame) -> DataFrame:
    """(arxiv_id, id, term, weight): unit vectors of (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) with n and df of the paper."""
    rows = chunks.where(F.col("arxiv_id").isNotNull() & F.col("id").isNotNull()).dropDuplicates(["arxiv_id", "id"])
    n = rows.groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("n"))
    terms = rows.select("arxiv_id", "id", F.explode("tokens").alias("term")).where("term is not null")
    tf = terms.groupBy("arxiv_id", "id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("arxiv_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, ["arxiv_id", "term"]).join(n, "arxiv_id").withColumn("w", (1 + F.log("tf")) * idf(F.col("n"), F.col("df")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("arxiv_id", "id")))
    return weighted.withColumn("norm", norm).select("arxiv_id", "id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def paper_vocabulary(chunks: DataFrame) -> DataFrame:
    """(arxiv_id, term, term_idx, df): a paper's terms, numbered from 0 by their order, and the chunks that hold them."""
    rows = chunks.where("arxiv_id is not null and id is not null").select("arxiv_id", "id", F.explode(F.array_distinct("tokens")).alias("term"))
    df = rows.where("term is not null").distinct().groupBy("arxiv_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("arxiv_id", "term", (F.row_number().over(Window.partitionBy("arxiv_id").orderBy("term")) - 1).alias("term_idx"), "df")


# --- versions -------------------------------------------------------------


def publish(index: Index, root: str) -> str:
    """Write index as a new version under root, on any file system Spark knows, and point to it.

    The pointer is replaced by one rename; readers see the old version until then.
    """
    spark = index.postings.sparkSession
    jvm, where, files = _file_system(spark, root)
    old = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    last = max((int(n[1:]) for n in old if n[:1] == "v" and n[1:].isdigit()), default=0)
    path = f"{root.rstrip('/')}/v{last + 1:06d}"
    index.save(path)
    fresh = jvm.org.apache.hadoop.fs.Path(root, "CURRENT.new")
    out = files.create(fresh, True)
    out.write(bytearray(path.rsplit("/", 1)[1].encode()))
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri())
    context.rename(files.makeQualified(fresh), files.makeQualified(jvm.org.apache.hadoop.fs.Path(root, "CURRENT")), options)
    return path


def current(spark: SparkSession, root: str) -> str:
    """Path of the version that root points to."""
    jvm, where, files = _file_system(spark, f"{root.rstrip('/')}/CURRENT")
    data = files.open(where)
    try:
        return f"{root.rstrip('/')}/{jvm.org.apache.commons.io.IOUtils.toString(data, 'UTF-8').strip()}"
    finally:
        data.close()


class IndexReader:
    """An index that is loaded anew when its root points to another version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._path, self._index = spark, root, "", None

    def get(self) -> Index:
        path = current(self.spark, self.root)
        if path != self._path:
            self._index, self._path = Index.load(self.spark, path), path
        return self._index
