"""Ranked retrieval for batches of queries as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import hints
from folioscan.functions import text as T
from folioscan.operators.indexing import Index, idf
from folioscan.operators.jobs import within
from folioscan.operators.matching import Scoring, block_candidates
from folioscan.runtime import broadcast_if_small, durable

#: Decimals to which scores are rounded before ranking, so that order does not hang on the order of additions.
RANK_DECIMALS = 9
#: Parts in which the matches of one query are cut down to its candidates.
SPREAD = 32


# Names of stored settings and the option that each is.
SETTINGS = {
    "kind": "kind", "perPaper": "per_paper_k", "maxResults": "top_k", "scoring": "scoring", "bm25K1": "k1", "bm25B": "b",
    "svdEnable": "svd", "svdTopN": "svd_top", "svdAlpha": "svd_alpha", "twoPassEnable": "two_pass", "twoPassTopN": "two_pass_top",
}

#: Distinct tokens of a batch of queries whose postings are looked up by id; a batch with more joins all postings.
LOOKUP_TOKENS = 4_000
#: Matches of a token of a query and a chunk, up to which a batch has a row for each; more are counted in blocks.
ROW_MATCHES = 2_000_000


@dataclass(frozen=True)
class SearchOptions:
    """Options of a search. Sizes of 0 mean the default; clamped() brings all into their ranges."""

    scoring: str = "tfidf"
    k1: float = 1.2
    b: float = 0.75
    top_k: int = 20
    kind: str = "both"
    max_candidates: int = 10_000
    top_m_tokens: int = 12
    offset: int = 0
    per_paper_k: int = 1
    no_filter: bool = False
    max_df_share: float = 0.15
    max_df: int = 200_000
    min_keep: int = 3
    scan_budget: int = 2_000_000
    max_results: int = 5_000
    most_candidates: int = 20_000
    two_pass: bool = False
    primary: str = "bm25"
    secondary: str = "cosine"
    two_pass_top: int = 2_000
    svd: bool = False
    svd_top: int = 2_000
    svd_alpha: float = 0.5
    base_by_last_v: bool = False
    math_hint_compat: bool = False
    #: Seconds that candidates and scores may take, both together; 0 is no limit.
    time_limit: float = 0.0

    def clamped(self) -> SearchOptions:
        return replace(
            self,
            top_k=max(1, min(self.top_k or 20, self.max_results)),
            max_candidates=max(100, min(self.max_candidates or 10_000, self.most_candidates)),
            top_m_tokens=self.top_m_tokens or 12,
            per_paper_k=self.per_paper_k or 1,
            two_pass_top=self.two_pass_top or 2_000,
            svd_top=self.svd_top or 2_000,
            svd_alpha=self.svd_alpha or 0.5,
        )

    def merged(self, changes: dict) -> SearchOptions:
        """These options with the changes to settings that users may store; other names are ignored."""
        return replace(self, **{SETTINGS[k]: v for k, v in changes.items() if k in SETTINGS})


def query_terms(queries: DataFrame, o: SearchOptions) -> DataFrame:
    """(query_id, term, cnt) of queries (query_id, query): tokens without stop words and single characters, counted."""
    terms = queries.select("query_id", F.explode(T.query_tokens(F.col("query"), o.math_hint_compat)).alias("term"))
    if not o.no_filter:
        terms = terms.where((F.length("term") >= 2) & ~F.col("term").isin(hints.STOPWORDS))
    return terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("cnt"))


def informative(terms: DataFrame, n_chunks: int, o: SearchOptions) -> DataFrame:
    """terms (query_id, term, cnt, token_id, df) without the too common ones.

    A query keeps all its terms if all are too common. One left with fewer than
    min_keep terms, unknown ones included, keeps the known among them of least
    (df, term), at most min_keep.
    """
    if o.no_filter:
        return terms
    df = F.coalesce("df", F.lit(0))
    common = (df >= o.max_df) | (df / F.lit(float(max(1, n_chunks))) >= o.max_df_share)
    q = Window.partitionBy("query_id")
    kept = terms.withColumn("_keep", ~common).withColumn("_any", F.max("_keep").over(q)).where("_keep or not _any")
    known = F.col("token_id").isNotNull()
    order = q.orderBy(F.when(known, 0).otherwise(1), df, "term")
    kept = kept.withColumn("_n", F.count(F.lit(1)).over(q)).withColumn("_r", F.row_number().over(order))
    return kept.where((F.col("_n") >= max(1, o.min_keep)) | (known & (F.col("_r") <= max(1, o.min_keep)))).drop("_keep", "_any", "_n", "_r")


def known_terms(index: Index, queries: DataFrame, o: SearchOptions) -> DataFrame:
    """(query_id, term, cnt, token_id, df) of all query terms; token_id is null for unknown ones. Queries without a known term drop out."""
    terms = query_terms(queries, o).join(index.tokens, "term", "left")
    some = F.max(F.col("token_id").isNotNull()).over(Window.partitionBy("query_id"))
    return terms.withColumn("_some", some).where("_some").drop("_some")


def query_vectors(index: Index, queries: DataFrame, o: SearchOptions) -> DataFrame:
    """(query_id, token_id, term, df, idf, q, chosen): unit query vectors, and the rare tokens chosen to find candidates.

    Chosen are the top_m_tokens rarest (idf, then token id, descending), while
    the sum of their df is within the scan budget, but one at least.
    """
    terms = informative(known_terms(index, queries, o), index.n_chunks, o).where("token_id is not null")
    return _weighted(terms, index.n_chunks, o.top_m_tokens, o.scan_budget)


def _weighted(terms: DataFrame, n_chunks: int, top_m: int, budget: int | None) -> DataFrame:
    q = Window.partitionBy("query_id")
    rare = q.orderBy(F.col("idf").desc(), F.col("token_id").desc())
    raw = terms.withColumn("idf", idf(n_chunks, F.col("df"))).withColumn("v", (1 + F.log("cnt")) * F.col("idf"))
    raw = raw.withColumn("_norm", F.sqrt(F.sum(F.col("v") * F.col("v")).over(q))).withColumn("_r", F.row_number().over(rare))
    upto = F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, 0))
    within = (F.col("_r") == 1) | (F.col("_upto") <= budget) if budget is not None else F.lit(True)
    return raw.withColumn("_upto", upto).select(
        "query_id", "token_id", "term", "df", "idf",
        F.when(F.col("_norm") > 0, F.col("v") / F.col("_norm")).otherwise(F.lit(0.0)).alias("q"),
        ((F.col("_r") <= top_m) & within).alias("chosen"),
    )


def _of_kind(index: Index, kind: str) -> DataFrame | None:
    if kind == "both":
        return None
    return index.chunks.where(F.col("kind") == kind).select("chunk_id")


def _listed(index: Index, vectors: DataFrame) -> tuple[DataFrame, bool]:
    """Postings of the tokens of vectors, or of all where these are too many to list, and whether they were listed.

    A scan with listed tokens reads their folders only.
    """
    listed = [r[0] for r in vectors.select("token_id").distinct().limit(LOOKUP_TOKENS + 1).collect()]
    few = len(listed) <= LOOKUP_TOKENS
    return index.postings_of(listed if few else None).drop("part"), few


def hits(index: Index, vectors: DataFrame, o: SearchOptions) -> DataFrame:
    """Postings of the tokens of vectors (durable or cheap), each with the columns of vectors, of chunks of the kind asked for."""
    found = _listed(index, vectors)[0].join(vectors, "token_id")
    kind = _of_kind(index, o.kind)
    return found if kind is None else found.join(kind, "chunk_id", "left_semi")


def _many_matches(vectors: DataFrame) -> bool:
    return (vectors.agg(F.sum("df")).first()[0] or 0) > ROW_MATCHES


def _batch_postings(index: Index, vectors: DataFrame, o: SearchOptions) -> DataFrame:
    """Postings of the tokens of vectors, each once, of chunks of the kind asked for."""
    found, listed = _listed(index, vectors)
    found = found if listed else found.join(vectors.select("token_id").distinct(), "token_id", "left_semi")
    kind = _of_kind(index, o.kind)
    return found if kind is None else found.join(kind, "chunk_id", "left_semi")


def candidates(index: Index, vectors: DataFrame, o: SearchOptions) -> DataFrame:
    """(query_id, chunk_id, matches): chunks by the number of chosen tokens they hold, ties by id; max_candidates after offset."""
    chosen = vectors.where("chosen").select("query_id", "token_id", "df", "chosen")
    if _many_matches(chosen):
        return block_candidates(_batch_postings(index, chosen, o), chosen, index.chunks.select("chunk_id"), o.offset + o.max_candidates, o.offset)
    found = hits(index, chosen.select("query_id", "token_id"), o)
    counts = found.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("matches"))
    return first_of(counts, o.offset + o.max_candidates, o.offset)


def first_of(counts: DataFrame, upto: int, after: int = 0) -> DataFrame:
    """Rows of counts (query_id, chunk_id, matches, ...) at the places after + 1 to upto of their query.

    A query that matches much of the collection is first cut in SPREAD parts side by side, so its last task gets
    at most SPREAD * upto rows.
    """
    order = [F.col("matches").desc(), F.col("chunk_id")]
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(SPREAD))
    local = counts.withColumn("_s", part).withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_s").orderBy(*order)))
    ranked = local.where(F.col("_r") <= upto).drop("_s").withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where((F.col("_r") > after) & (F.col("_r") <= upto)).drop("_r")


def bm25_idf(n_chunks: int, df: Column) -> Column:
    return F.log(1 + F.greatest(F.lit(0.0), F.lit(float(n_chunks)) - df + 0.5) / (df + 0.5))


def _owners(index: Index, o: SearchOptions) -> DataFrame:
    """(paper_id, owner) of the papers of chunks; versions of a paper have one owner."""
    ids = index.chunks.select("paper_id").distinct().join(index.papers.select("paper_id", "arxiv_id"), "paper_id", "left")
    base = T.base_id(F.coalesce("arxiv_id", F.col("paper_id").cast("string")), o.base_by_last_v)
    return ids.select("paper_id", F.min("paper_id").over(Window.partitionBy(base)).alias("owner"))


def _scored_in_blocks(index: Index, vectors: DataFrame, o: SearchOptions, cut: bool) -> DataFrame:
    norm = F.coalesce(F.nullif(F.col("norm"), F.lit(0.0)), F.lit(1.0)).alias("norm")
    facts = index.chunks.select("chunk_id", "paper_id", norm)
    if cut:
        # Chunks without a paper count as of one.
        facts = facts.join(_owners(index, o), "paper_id", "left").withColumn("owner", F.coalesce("owner", F.lit(-(1 << 63))))
    else:
        facts = facts.withColumn("owner", F.lit(0).cast("long"))
    weighted = vectors.withColumns({"weight": F.col("q") * F.col("idf"), "bm25_idf": bm25_idf(index.n_chunks, F.col("df"))})
    weighted = weighted.select("query_id", "token_id", "chosen", "weight", "bm25_idf")
    scoring = Scoring(max(index.avgdl, 1e-12), o.k1, o.b, RANK_DECIMALS, "bm25" if o.scoring == "bm25" else "cosine", o.top_k if cut else None, o.per_paper_k)
    found = block_candidates(_batch_postings(index, vectors, o), weighted, durable(facts, "chunk-facts"), o.offset + o.max_candidates, o.offset, scoring)
    rows = found.join(index.chunks.select("chunk_id", "paper_id", "kind"), "chunk_id")
    return rows.select("query_id", "chunk_id", "paper_id", "kind", "cosine", "bm25")


def scored(index: Index, vectors: DataFrame, o: SearchOptions, cut: bool = False) -> DataFrame:
    """(query_id, chunk_id, paper_id, kind, cosine, bm25) of candidates; with cut, those that cap_papers drops after a plain rank may be missing.

    One pass over the postings of the query terms counts the chosen tokens a
    chunk holds and sums both scores, since a posting carries its chunk's
    length; then the candidates are cut off, and only they get their chunk's facts. Texts stay out of it.
    """
    if _many_matches(vectors):
        return _scored_in_blocks(index, vectors, o, cut)
    tf, avgdl = F.col("tf"), max(index.avgdl, 1e-12)
    saturated = (o.k1 + 1) * tf / (tf + o.k1 * (1 - o.b + o.b * F.col("dl") / avgdl))
    sums = hits(index, vectors.select("query_id", "token_id", "df", "idf", "q", "chosen"), o).groupBy("query_id", "chunk_id").agg(
        F.sum(F.col("chosen").cast("long")).alias("matches"),
        F.sum(F.col("q") * (1 + F.log(tf)) * F.col("idf")).alias("dot"),
        F.sum(saturated * bm25_idf(index.n_chunks, F.col("df"))).alias("bm25"),
    )
    found = first_of(sums.where("matches > 0"), o.offset + o.max_candidates, o.offset)
    rows = found.join(index.chunks.select("chunk_id", "paper_id", "kind", "norm"), "chunk_id")
    norm = F.coalesce(F.nullif(F.col("norm"), F.lit(0.0)), F.lit(1.0))
    return rows.select(
        "query_id", "chunk_id", "paper_id", "kind",
        F.round(F.col("dot") / norm, RANK_DECIMALS).alias("cosine"), F.round("bm25", RANK_DECIMALS).alias("bm25"),
    )


def rank(scored: DataFrame, o: SearchOptions) -> DataFrame:
    """scored with place, from 1 within a query: by the scoring, or in two passes, where the head by the primary score is put in order of the secondary."""
    q = Window.partitionBy("query_id")

    def column(name: str) -> Column:
        return F.col("bm25" if name == "bm25" else "cosine")

    if not o.two_pass:
        return scored.withColumn("place", F.row_number().over(q.orderBy(column(o.scoring).desc(), "chunk_id")))
    first = "cosine" if o.primary == "cosine" else "bm25"
    second = "bm25" if o.secondary == "bm25" else "cosine"
    placed = scored.withColumn("_p", F.row_number().over(q.orderBy(column(first).desc(), "chunk_id")))
    head = F.col("_p") <= o.two_pass_top
    order = q.orderBy(head.desc(), F.when(head, column(second)).desc_nulls_last(), F.col("_p"))
    return placed.withColumn("place", F.row_number().over(order)).drop("_p")


def blend_latent(ranked: DataFrame, query_vectors_: DataFrame, embeddings: DataFrame, o: SearchOptions) -> DataFrame:
    """ranked put in order of alpha * cosine + (1 - alpha) * latent for the svd_top first, and of cosine for the rest.

    query_vectors_ is (query_id, qv), embeddings (chunk_id, v). A chunk without an
    embedding keeps its cosine; the cosine column then holds the blend. Only
    vectors of chunks among a query's first are read on.
    """
    wanted = durable(ranked.where(F.col("place") <= o.svd_top).select("chunk_id").distinct(), "blended-chunks")
    embeddings = embeddings.join(broadcast_if_small(wanted), "chunk_id", "left_semi")
    rows = ranked.join(embeddings, "chunk_id", "left").join(query_vectors_, "query_id", "left")
    dot = F.aggregate(F.zip_with("qv", "v", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    blend = F.when((F.col("place") <= o.svd_top) & dot.isNotNull(), o.svd_alpha * F.col("cosine") + (1 - o.svd_alpha) * dot).otherwise(F.col("cosine"))
    order = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "_old")
    rows = rows.withColumn("cosine", F.round(blend, RANK_DECIMALS)).withColumnRenamed("place", "_old")
    return rows.withColumn("place", F.row_number().over(order)).drop("_old", "v", "qv")


def cap_papers(ranked: DataFrame, papers: DataFrame, o: SearchOptions) -> DataFrame:
    """The first top_k of each query with at most per_paper_k of one paper, versions of a paper counting as one: adds arxiv_id and position."""
    ids = papers.select("paper_id", "arxiv_id")
    named = ranked.join(ids, "paper_id", "left").withColumn("arxiv_id", F.coalesce("arxiv_id", F.col("paper_id").cast("string")))
    base = T.base_id(F.col("arxiv_id"), o.base_by_last_v)
    in_paper = Window.partitionBy("query_id", "_base").orderBy("place")
    few = named.withColumn("_base", base).withColumn("_c", F.row_number().over(in_paper)).where(F.col("_c") <= o.per_paper_k)
    placed = few.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("place")))
    return placed.where(F.col("position") <= o.top_k).drop("_base", "_c")


def search(index: Index, queries: DataFrame, options: SearchOptions | None = None, latent: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Results of queries (query_id, query): (query_id, position, paper_id, chunk_id, kind, text, score, cosine, bm25, scoring).

    paper_id is the paper's public id, text at most 2,000 characters. A query
    that is null, empty or without a known term has no rows. Texts are joined
    to the few rows that are left at the end. latent is (query vectors, chunk
    embeddings) for the latent re-ranking.
    """
    o = (options or SearchOptions()).clamped()
    # The terms of a batch of queries are few; sent to the postings, these need no shuffle before they are cut down.
    vectors = broadcast_if_small(durable(query_vectors(index, queries, o), "query-vectors"))
    blended = o.svd and latent is not None
    cut = not (o.two_pass or blended)
    if o.time_limit > 0:
        scores = within(index.postings.sparkSession, o.time_limit, lambda: durable(scored(index, vectors, o, cut), "scores"))
    else:
        scores = scored(index, vectors, o, cut)
    ranked = rank(scores, o)
    if blended:
        ranked = blend_latent(ranked, latent[0], latent[1], o)
    top = cap_papers(ranked, index.papers, o)
    out = top.join(index.chunks.select("chunk_id", "text"), "chunk_id")
    return out.select(
        "query_id", "position", F.col("arxiv_id").alias("paper_id"), "chunk_id", "kind",
        F.substring(F.coalesce("text", F.lit("")), 1, 2000).alias("text"),
        F.col("bm25" if o.scoring == "bm25" else "cosine").alias("score"), "cosine", "bm25", F.lit(o.scoring).alias("scoring"),
    )


def dims(vectors: DataFrame) -> DataFrame:
    """(query_id, dim, term): the two terms of largest query weight, ties by term."""
    order = Window.partitionBy("query_id").orderBy(F.round(F.abs("q"), RANK_DECIMALS).desc(), "term")
    return vectors.withColumn("dim", F.row_number().over(order)).where("dim <= 2").select("query_id", "dim", "term")


def score_bars(results: DataFrame) -> DataFrame:
    """results with cos_pct, clamped to 0 and 100, and bm25_pct of the query's greatest bm25."""
    most = F.max("bm25").over(Window.partitionBy("query_id"))
    most = F.when(most > 0, most).otherwise(1.0)

    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))

    return results.withColumn("cos_pct", clamp(F.col("cosine") * 100)).withColumn("bm25_pct", clamp(F.col("bm25") / most * 100))


def resort(results: DataFrame, metric: str = "cosine", ascending: bool = False) -> DataFrame:
    """results with new_position by a metric; reset gives the original order."""
    column = F.col("position") if metric == "reset" else F.col(metric).asc() if ascending else F.col(metric).desc()
    return results.withColumn("new_position", F.row_number().over(Window.partitionBy("query_id").orderBy(column, "position")))


def collection_counts(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table, counted side by side."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def paper_chunk_counts(index: Index) -> DataFrame:
    """(paper_id, arxiv_id, chunks) of every paper, 0 for one without chunks."""
    counts = index.chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("chunks"))
    joined = index.papers.join(counts, "paper_id", "left")
    return joined.select("paper_id", "arxiv_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
