"""Queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import text as T
from folioscan.operators import context as C
from folioscan.operators import ingest as G
from folioscan.operators import latent as L
from folioscan.operators import metadata as M
from folioscan.operators import search as S
from folioscan.operators.indexing import Index, IndexReader, index_from_chunks, index_from_tables, paper_vocabulary, per_paper_tfidf, publish, unique_papers
from folioscan.operators.skew import heavy_keys, key_quantiles, key_statistics
from folioscan.plans import fixtures, sql
from folioscan.runtime import durable, generation, keeping, scratch_path, table
from folioscan.sources import archives as A
from folioscan.sources import harvest as H
from folioscan.sources import records as R
from folioscan.streaming.ingest import RECORD_SCHEMA, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


_built: dict[tuple, Index] = {}


def index(spark: SparkSession, d: str) -> Index:
    """The index of the tables in d, built once a session, as a search service would keep it."""
    key = (*generation(spark), d)
    if key not in _built:
        with keeping():
            _built[key] = index_from_tables(*(table(spark, d, t) for t in ("paper", "chunk", "token", "posting")))
    return _built[key]


def titles(ix: Index) -> DataFrame:
    """The stated query set: titles of papers whose id is divisible by 20."""
    rows = ix.papers.where("paper_id % 20 = 0 and title is not null")
    return durable(rows.select(F.col("paper_id").alias("query_id"), F.col("title").alias("query")), "queries")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- skew -----------------------------------------------------------------


def _key_stats(spark: SparkSession, d: str) -> DataFrame:
    return key_statistics(table(spark, d, "posting"), "token_id", "chunk_id", "tf")


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The hot keys of both fields, from the exact selection run for them: each has its median, of which its number of rows is the first round."""
    posting = table(spark, d, "posting")
    total = F.lit(float(posting.count()))

    def hot(profile: DataFrame) -> DataFrame:
        return heavy_keys(profile, total, {"token_id": 0.02}, {"chunk_id": 500})

    return key_quantiles(posting, ("token_id", "chunk_id"), "tf", (0.5,), least=hot).select("key_field", "key_id")


@query
def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    return _key_stats(spark, d)


@query
def p4_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return key_quantiles(table(spark, d, "posting"), ("token_id", "chunk_id"), "tf", (0.25, 0.5, 0.9))


# --- index ----------------------------------------------------------------


@query
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.collection_counts(**{t: table(spark, d, t) for t in ("token", "paper", "chunk", "posting")})


@query
def papers_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    return S.paper_chunk_counts(index(spark, d))


@query
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """A build from scratch each time: its postings."""
    return index_from_tables(*(table(spark, d, t) for t in ("paper", "chunk", "token", "posting"))).postings.select("token_id", "chunk_id", "tf")


@query
def token_df(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).tokens


@query
def chunk_norms(spark: SparkSession, d: str) -> DataFrame:
    return rounded(index(spark, d).chunks.select("chunk_id", "norm", "dl"), "norm")


@query
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    ix = index(spark, d)
    return spark.createDataFrame([(ix.n_chunks, round(ix.avgdl, 6))], "n_chunks long, avgdl double")


@query
def built_postings(spark: SparkSession, d: str) -> DataFrame:
    ix = index_from_chunks(table(spark, d, "chunks"))
    return ix.postings.join(ix.tokens, "token_id").select("term", "chunk_id", "tf")


@query
def paper_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    return paper_vocabulary(table(spark, d, "chunks"))


@query
def paper_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(per_paper_tfidf(table(spark, d, "chunks")), "weight")


# --- text -----------------------------------------------------------------


def _chunks_of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    rows = table(spark, d, "chunk").where(T.clean_kind(F.col("kind")) == kind).where("id is not null and text is not null")
    return rows.select(F.col("id").alias("chunk_id"), "text").dropDuplicates(["chunk_id"])


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text")


@query
def text_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _chunks_of(spark, d, "paragraph").select("chunk_id", F.posexplode(T.text_tokens(F.col("text"))).alias("pos", "token"))


@query
def math_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _chunks_of(spark, d, "equation").select("chunk_id", F.posexplode(T.math_tokens(F.col("text"))).alias("pos", "token"))


@query
def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk").where("id is not null and text is not null")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.min(T.clean_kind(F.col("kind"))).alias("kind"))
    return rows.select(F.col("id").alias("chunk_id"), F.posexplode(T.chunk_tokens(F.col("text"), F.col("kind"))).alias("pos", "token"))


@query
def singular_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "token").where("term is not null").select("term").distinct()
    return terms.select("term", T.singular(F.col("term")).alias("singular"))


@query
def math_segments(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(T.math_segments(F.col("text"))).alias("pos", "segment"))


@query
def comments_stripped(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.strip_comments(F.col("text")).alias("text"))


@query
def comments_stripped_lenient(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.strip_comments_lenient(F.col("text")).alias("text"))


@query
def latex_text(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", T.latex_to_text(F.col("text")).alias("text"))


@query
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query
def paper_ids(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("arxiv_id")
    rows = unique_papers(table(spark, d, "paper"))
    return rows.select("paper_id", T.normal_id(a).alias("normal"), T.base_id(a).alias("base"), T.paper_url(a).alias("abs_url"), T.paper_url(a, "pdf").alias("pdf_url"))


# --- archives ---------------------------------------------------------------


@query
def archive_scan(spark: SparkSession, d: str) -> DataFrame:
    return A.scan_archives(spark, fixtures.archive_folder(spark)).select("arxiv_id")


def _members(spark: SparkSession) -> DataFrame:
    return A.archive_members(A.scan_archives(spark, fixtures.archive_folder(spark)))


@query
def archive_files(spark: SparkSession, d: str) -> DataFrame:
    return _members(spark).select("arxiv_id", "member", F.length("text").alias("chars"))


@query
def archive_main_files(spark: SparkSession, d: str) -> DataFrame:
    return A.main_files(_members(spark)).select("arxiv_id", "member", "place")


@query
def math_blocks(spark: SparkSession, d: str) -> DataFrame:
    parts = A.separate_math(A.combined_sources(_members(spark)))
    return parts.select("arxiv_id", F.posexplode("blocks").alias("n", "block"))


@query
def archive_chunks(spark: SparkSession, d: str) -> DataFrame:
    """From archives to chunk records, with the papers already there left out."""
    present = spark.createDataFrame([("0705.0002",)], "arxiv_id string")
    rows = A.vectorize(spark, fixtures.archive_folder(spark), present)
    return rows.select("arxiv_id", "id", "kind", "text", F.array_join("tokens", " ").alias("tokens"))


@query
def latex_sources(spark: SparkSession, d: str) -> DataFrame:
    return A.latex_texts(spark, fixtures.archive_folder(spark)).select("arxiv_id", F.length("text").alias("chars"), F.contains("text", F.lit("A reference.")).alias("with_references"))


@query
def latex_metadata(spark: SparkSession, d: str) -> DataFrame:
    found = M.from_latex(A.latex_texts(spark, fixtures.archive_folder(spark)))
    return found.select("arxiv_id", "title", F.array_join("authors", "|").alias("authors"), "abstract", "source")


# --- sources and stores -----------------------------------------------------


@query
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    rows = R.read_chunks(spark, fixtures.record_folder(spark))
    return rows.select("arxiv_id", "id", "kind", "text", F.array_join("tokens", " ").alias("tokens"))


@query
def oai_listing(spark: SparkSession, d: str) -> DataFrame:
    return H.read_listings(spark, fixtures.listing_folder(spark))


@query
def atom_feed(spark: SparkSession, d: str) -> DataFrame:
    rows = H.read_feeds(spark, fixtures.feed_folder(spark))
    return rows.select("arxiv_id", "title", F.array_join("authors", "|").alias("authors"), F.array_join("subjects", "|").alias("subjects"), "abstract", "doi", "source")


@query
def metadata_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Ids of all papers that a cache of paper_meta lacks, fetched and written through to it."""
    cache = scratch_path(spark, "metadata-cache")
    table(spark, d, "paper_meta").write.parquet(cache)
    return H.refresh_metadata(table(spark, d, "paper").select("arxiv_id"), cache, fixtures.fetch, "http://host/api")


@query
def stored_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written and read again for some chunks only."""
    path = scratch_path(spark, "embeddings")
    R.write_embeddings(_unit_vectors(spark, d), path)
    some = table(spark, d, "chunk").where("id % 3 = 0").select(F.col("id").alias("chunk_id"))
    return R.read_embeddings(spark, path, some).select("chunk_id", F.size("v").alias("numbers"))


@query
def published_index(spark: SparkSession, d: str) -> DataFrame:
    """The index published as a new version, and its postings as a reader of the current version finds them."""
    root = scratch_path(spark, "published")
    publish(index(spark, d), root)
    return IndexReader(spark, root).get().postings.select("token_id", "chunk_id", "tf", "dl")


@query
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The chunk records as a stream into a store that is empty at first."""
    store = scratch_path(spark, "stream-store")
    scratch = scratch_path(spark, "stream-checkpoint")
    arrivals = spark.readStream.schema(RECORD_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{d}/chunks.parque[t]")
    ingest(arrivals, store, scratch).awaitTermination()
    return _per_paper(spark.read.parquet(store))


# --- metadata -------------------------------------------------------------


@query
def metadata_cards(spark: SparkSession, d: str) -> DataFrame:
    return M.metadata_cards(M.latest_records(table(spark, d, "paper_meta")))


@query
def metadata_from_chunks(spark: SparkSession, d: str) -> DataFrame:
    return M.from_chunks(table(spark, d, "chunks")).select("arxiv_id", "abstract")


@query
def metadata_all(spark: SparkSession, d: str) -> DataFrame:
    found = M.paper_metadata(table(spark, d, "paper").select("arxiv_id"), table(spark, d, "paper_meta"), chunks=table(spark, d, "chunks"))
    return found.select("arxiv_id", "title", "abstract", "source")


# --- search ---------------------------------------------------------------


@query
def query_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = unique_papers(table(spark, d, "paper")).where("paper_id % 20 = 0 and title is not null")
    tokens = rows.select(F.col("paper_id").alias("query_id"), F.explode(T.query_tokens(F.col("title"))).alias("term"))
    return tokens.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("cnt"))


@query
def tokenize_stages(spark: SparkSession, d: str) -> DataFrame:
    rows = unique_papers(table(spark, d, "paper")).where("title is not null")
    stages = rows.select("paper_id", T.tokenize_stages(F.col("title")).alias("s"))
    return stages.select("paper_id", *[F.array_join(f"s.{c}", " ").alias(c) for c in ("text_tokens", "math_segments", "math_tokens", "final")])


@query
def query_cases(spark: SparkSession, d: str) -> DataFrame:
    """The stages of tokenizing queries that hold formulas, symbols, operators and placeholders."""
    rows = spark.createDataFrame(list(enumerate(fixtures.QUERIES)), "query_id int, q string")
    stages = rows.select("query_id", T.tokenize_stages(F.col("q")).alias("s"))
    return stages.select("query_id", *[F.array_join(f"s.{c}", " ").alias(c) for c in ("text_tokens", "math_segments", "math_tokens", "final")])


@query
def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    ix = index(spark, d)
    return rounded(S.query_vectors(ix, titles(ix), S.SearchOptions()), "idf", "q")


@query
def scan_budget(spark: SparkSession, d: str) -> DataFrame:
    ix = index(spark, d)
    return S.query_vectors(ix, titles(ix), S.SearchOptions(top_m_tokens=4, scan_budget=300)).select("query_id", "token_id", "df", "chosen")


@query
def candidates(spark: SparkSession, d: str) -> DataFrame:
    ix, o = index(spark, d), S.SearchOptions()
    return S.candidates(ix, durable(S.query_vectors(ix, titles(ix), o), "query-vectors"), o)


def _search(spark: SparkSession, d: str, **options: object) -> DataFrame:
    ix = index(spark, d)
    return S.search(ix, titles(ix), S.SearchOptions(**options))


def _shown(results: DataFrame) -> DataFrame:
    return rounded(results, "score", "cosine", "bm25")


@query
def search_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_search(spark, d))


@query
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_search(spark, d, scoring="bm25"))


@query
def search_two_pass(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_search(spark, d, two_pass=True))


@query
def search_kind(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_search(spark, d, kind="paragraph"))


@query
def search_unfiltered(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_search(spark, d, no_filter=True))


@query
def search_per_paper(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_search(spark, d, top_k=50, per_paper_k=3))


@query
def query_dims(spark: SparkSession, d: str) -> DataFrame:
    ix = index(spark, d)
    return S.dims(S.query_vectors(ix, titles(ix), S.SearchOptions()))


@query
def score_bars(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.score_bars(_search(spark, d)).select("query_id", "position", "cos_pct", "bm25_pct"), "cos_pct", "bm25_pct")


@query
def resorted(spark: SparkSession, d: str) -> DataFrame:
    return S.resort(_search(spark, d), "bm25").select("query_id", "position", "new_position")


def _unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Usable chunk_svd rows at length 1."""
    finite = F.forall("v", lambda x: ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    rows = table(spark, d, "chunk_svd").where((F.size("v") == 64) & finite).select(F.col("id").alias("chunk_id"), F.col("v").cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.dropDuplicates(["chunk_id"]).withColumn("n", norm)
    return rows.select("chunk_id", F.transform("v", lambda x: x / F.col("n")).alias("v"))


@query
def latent_blend(spark: SparkSession, d: str) -> DataFrame:
    ix, o = index(spark, d), S.SearchOptions(svd=True)
    qs = titles(ix)
    vectors = durable(S.query_vectors(ix, qs, o), "query-vectors")
    ranked = durable(S.rank(S.scored(ix, vectors, o), o), "ranked")
    units = durable(_unit_vectors(spark, d), "unit-vectors")
    first = ix.chunks.join(units, "chunk_id").groupBy(F.col("paper_id").alias("query_id")).agg(F.min("chunk_id").alias("chunk_id"))
    of_query = first.join(qs, "query_id", "left_semi").join(units, "chunk_id").select("query_id", F.col("v").alias("qv"))
    return rounded(S.blend_latent(ranked, of_query, units, o).select("query_id", "chunk_id", "cosine", "place"), "cosine")


@query
def search_latent(spark: SparkSession, d: str) -> DataFrame:
    ix, o = index(spark, d), S.SearchOptions(svd=True)
    qs = titles(ix)
    components = durable(L.fit_svd(ix), "components")
    latent = L.embed_queries(S.query_vectors(ix, qs, o), components), L.embed_chunks(ix, components)
    return S.search(ix, qs, o, latent).select("query_id", "position", "chunk_id")


@query
def word_vectors(spark: SparkSession, d: str) -> DataFrame:
    vectors = L.fit_word_vectors(table(spark, d, "chunks")).getVectors()
    return vectors.select("word", vector_to_array("vector").alias("vector"))


# --- context --------------------------------------------------------------


@query
def rag_select(spark: SparkSession, d: str) -> DataFrame:
    ix = index(spark, d)
    return C.rag_select(ix, titles(ix))


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ix = index(spark, d)
    qs = titles(ix)
    return C.rag_context(ix, qs), qs


@query
def rag_context(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[0]


@query
def offline_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.offline_summary(_packed(spark, d)[0])


@query
def prompts(spark: SparkSession, d: str) -> DataFrame:
    return C.prompts(*_packed(spark, d))


@query
def previews(spark: SparkSession, d: str) -> DataFrame:
    return C.previews(_packed(spark, d)[0])


@query
def paper_texts(spark: SparkSession, d: str) -> DataFrame:
    return C.paper_texts(index(spark, d), 24_000).where("paper_id is not null")


def _attached(ix: Index) -> DataFrame:
    return ix.papers.where("arxiv_id is not null").select(F.floor(F.col("paper_id") / 4).alias("session_id"), F.col("paper_id").alias("seq"), "arxiv_id")


@query
def chat_context(spark: SparkSession, d: str) -> DataFrame:
    ix = index(spark, d)
    return C.chat_context(ix, _attached(ix))


@query
def full_papers(spark: SparkSession, d: str) -> DataFrame:
    """Whole papers of a client's list, in its order, under a budget that cuts some."""
    ix = index(spark, d)
    wanted = _attached(ix).select(F.col("session_id").alias("query_id"), (-F.col("seq")).alias("paper_rank"), "arxiv_id")
    return C.full_paper_context(ix, wanted)


@query
def client_papers(spark: SparkSession, d: str) -> DataFrame:
    """Chunks to read of the papers that a client names with its query, in the client's order."""
    ix = index(spark, d)
    qs = titles(ix)
    near = qs.join(ix.papers.where("arxiv_id is not null"), F.col("paper_id").between(F.col("query_id"), F.col("query_id") + 40))
    named = near.select("query_id", (F.col("query_id") + 40 - F.col("paper_id")).alias("pos"), "arxiv_id")
    return C.rag_select(ix, qs, client_papers=named)


@query
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Papers attached to chat sessions now, with the events of a user as those of a session: views and clicks add, purchases remove, errors clear."""
    kind = F.col("event_type")
    action = F.when(kind.isin("view", "click"), "add").when(kind == "purchase", "remove").when((kind == "error") & (F.col("value") > 100), "clear").otherwise("none")
    mode = F.when(kind == "click", "vectors").otherwise(F.lit(None).cast("string"))
    paper = F.floor("value").cast("string")
    events = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), action.alias("action"), paper.alias("paper_id"), mode.alias("mode"))
    return C.session_papers(events)


@query
def public_ids(spark: SparkSession, d: str) -> DataFrame:
    papers = unique_papers(table(spark, d, "paper"))
    ids = papers.select(F.col("paper_id").cast("string").alias("id")).union(papers.select("arxiv_id")).where("id is not null").distinct()
    return C.public_ids(ids, papers)


# --- ingest ---------------------------------------------------------------


def _per_paper(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("arxiv_id").agg(F.count(F.lit(1)).alias("records"))


@query
def allowlist_ingest(spark: SparkSession, d: str) -> DataFrame:
    return _per_paper(G.allowlisted(table(spark, d, "chunks"), table(spark, d, "paper").where("year = 2010").select("arxiv_id")))


@query
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    fresh = G.not_yet_present(table(spark, d, "chunks"), table(spark, d, "paper").where("year <= 2012").select("arxiv_id"))
    return _per_paper(fresh.where("arxiv_id is not null"))


@query
def mini_dataset(spark: SparkSession, d: str) -> DataFrame:
    return G.mini_dataset(table(spark, d, "chunks"), 50, 200).select("arxiv_id", "id")


@query
def sharded(spark: SparkSession, d: str) -> DataFrame:
    return G.sharded(table(spark, d, "chunks"), 4).groupBy("shard").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("arxiv_id").alias("papers"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


_KEYS = """
with f as (select token_id, chunk_id, tf, count(*) as n from posting group by all),
p as (select token_id, chunk_id, sum(n) as n, sum(tf) as tf from f group by all),
k as (select 'token_id' as key_field, token_id as key_id, sum(n)::bigint as rows, count(chunk_id) as partners, coalesce(sum(tf), 0.0) as total from p where token_id is not null group by all
union all select 'chunk_id', chunk_id, sum(n)::bigint, count(token_id), coalesce(sum(tf), 0.0) from p where chunk_id is not null group by all)
"""


def oracle_sql() -> dict[str, str]:
    core = sql.oracle_sql()
    core["paper_vocabularies"] = core.pop("paper_vocabulary")
    core["paper_tfidf"] = core.pop("per_paper_tfidf")
    return core | {
        "p4_found": f"""{_KEYS} select key_field, key_id from k
            where (key_field = 'token_id' and rows >= 0.02 * (select count(*) from posting)) or (key_field = 'chunk_id' and rows >= 500)""",
        "p4_keys": f"{_KEYS} select * from k",
        "p4_quantiles": " union all ".join(
            f"select '{k}' as key_field, {k} as key_id, {f}::double as fraction, count(*) as rows, count(tf) as n, quantile_disc(tf, {f}) as quantile from posting where {k} is not null group by {k}"
            for f in (0.25, 0.5, 0.9) for k in ("token_id", "chunk_id")
        ),
    }
