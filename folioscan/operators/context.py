"""Selecting and packing text for a reader: retrieval-augmented context, chat context, prompts, previews and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import text as T
from folioscan.operators.indexing import Index
from folioscan.operators.search import SearchOptions, _weighted, candidates, first_of, hits, known_terms
from folioscan.runtime import broadcast_if_small, durable

#: Neighbouring order values whose rows one task adds up.
_BUCKET = 4096
# The words around excerpts in a prompt and in a summary without a model.
_INTRO = "You are a careful assistant. Read the following excerpts to answer the user's question. Cite papers as [paperId].\n\n"
_OUTRO = "\n\nAnswer succinctly with citations like [paperId]."
_OFFLINE_HEAD = "Offline mode: LLM unavailable. Showing excerpts related to your question.\n"
_OFFLINE_TAIL = "\nTip: Save an OpenAI API key in Settings to enable full answers."


def rag_select(
    index: Index, queries: DataFrame, top_papers: int = 5, chunks_per_paper: int = 5, client_papers: DataFrame | None = None
) -> DataFrame:
    """(query_id, paper_rank, paper_id, arxiv_id, chunk_rank, chunk_id): chunks to read for each query.

    The 12 rarest known query tokens, none filtered out, find candidates; a
    chunk's order is matches descending, then id. Papers come in the order of
    their first chunk, or with client_papers (query_id, pos, arxiv_id) only
    those and in that order; each gives its first chunks.
    """
    o = SearchOptions(no_filter=True, max_candidates=max(2000, top_papers * chunks_per_paper * 20), most_candidates=1 << 30)
    vectors = _weighted(known_terms(index, queries, o).where("token_id is not null"), index.n_chunks, 12, None)
    vectors = broadcast_if_small(durable(vectors, "query-vectors"))
    where = index.chunks.select("chunk_id", "paper_id").join(index.papers.select("paper_id", "arxiv_id"), "paper_id", "left")
    if client_papers is None:
        found = candidates(index, vectors, o).join(where, "chunk_id")
        first = F.min("_o").over(Window.partitionBy("query_id", "paper_id"))
    else:
        chosen = client_papers.groupBy("query_id", "arxiv_id").agg(F.min("pos").alias("_pos"))
        found = hits(index, vectors.where("chosen").select("query_id", "token_id"), o).join(where, "chunk_id")
        counts = found.join(chosen, ["query_id", "arxiv_id"]).groupBy("query_id", "chunk_id", "paper_id", "arxiv_id", "_pos")
        found = first_of(counts.agg(F.count(F.lit(1)).alias("matches")), o.max_candidates)
        first = F.col("_pos")
    q = Window.partitionBy("query_id")
    ordered = found.withColumn("_o", F.row_number().over(q.orderBy(F.col("matches").desc(), "chunk_id"))).withColumn("_first", first)
    in_paper = Window.partitionBy("query_id", "paper_id").orderBy("_o")
    few = ordered.withColumn("chunk_rank", F.row_number().over(in_paper)).where(F.col("chunk_rank") <= chunks_per_paper)
    few = few.withColumn("paper_rank", F.dense_rank().over(q.orderBy("_first", "paper_id"))).where(F.col("paper_rank") <= top_papers)
    return few.select("query_id", "paper_rank", "paper_id", F.coalesce("arxiv_id", F.col("paper_id").cast("string")).alias("arxiv_id"), "chunk_rank", "chunk_id")


def blocks(selected: DataFrame, index: Index) -> DataFrame:
    """(query_id, paper_rank, arxiv_id, text): the selected chunks of each paper in id order, trimmed, placeholders dropped, blank lines between."""
    texts = selected.join(index.chunks.select("chunk_id", "text"), "chunk_id").withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    texts = texts.where(F.length("text") > 0).withColumn("text", T.drop_placeholders(F.col("text")))
    # At most chunks_per_paper texts a group.
    joined = texts.groupBy("query_id", "paper_rank", "arxiv_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("t"))
    return joined.select("query_id", "paper_rank", "arxiv_id", F.array_join("t.text", "\n\n").alias("text"))


def pack(rows: DataFrame, group: list[str], order: str, text: str, budget: Column | int) -> DataFrame:
    """rows whose text still fits a character budget of their group, in order, with sent, sent_chars, total_chars and truncated.

    A row is kept while the texts before it leave room; the last is cut. Empty
    and null texts take no part.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    sized = rows.where(F.length(text) > 0).withColumn("total_chars", F.length(text).cast("long"))
    before = F.sum("total_chars").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    room = budget - F.coalesce(before, F.lit(0))
    fit = sized.withColumn("_room", room.cast("int")).where("_room > 0")
    fit = fit.withColumn("sent", F.substring(F.col(text), F.lit(1), F.col("_room"))).withColumn("sent_chars", F.length("sent").cast("long"))
    return fit.withColumn("truncated", F.col("total_chars") > F.col("_room")).drop("_room")


def rag_context(index: Index, queries: DataFrame, token_budget: int = 6000, top_papers: int = 5, chunks_per_paper: int = 5, client_papers: DataFrame | None = None) -> DataFrame:
    """(query_id, paper_rank, arxiv_id, sent, sent_chars, total_chars, truncated) within four characters a token of budget."""
    chosen = blocks(rag_select(index, queries, top_papers, chunks_per_paper, client_papers), index)
    return pack(chosen, ["query_id"], "paper_rank", "text", 4 * token_budget).drop("text")


def running_total(rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """rows with the sum of value over the rows of the group up to each, by a unique integral order.

    Sums go by buckets of neighbouring order values, so a group of any size is spread over tasks.
    """
    bucketed = rows.withColumn("_b", F.floor(F.col(order) / _BUCKET))
    sums = bucketed.groupBy(group, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_from", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    within = F.sum(value).over(Window.partitionBy(group, "_b").orderBy(order))
    return bucketed.withColumn("_w", within).join(sums, [group, "_b"]).withColumn(name, F.col("_from") + F.col("_w")).drop("_b", "_w", "_from")


def paper_texts(index: Index, max_chars: int, only: DataFrame | None = None) -> DataFrame:
    """(paper_id, text, total_chars): the chunks of each paper, or of those in only (paper_id), in id order with blank lines between, cut at max_chars.

    Chunks of other papers and chunks wholly beyond the cut are left out before any text moves.
    """
    chunks = index.chunks
    if only is not None:
        chunks = chunks.join(broadcast_if_small(durable(only.select("paper_id").where("paper_id is not null").distinct(), "asked-papers")), "paper_id", "left_semi")
    texts = chunks.select("paper_id", "chunk_id", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"))
    texts = texts.where(F.length("text") > 0).withColumn("n", F.length("text").cast("long") + 2)
    upto = running_total(texts.select("paper_id", "chunk_id", "n"), "paper_id", "chunk_id", "n", "upto")
    total = upto.groupBy("paper_id").agg((F.max("upto") - 2).alias("total_chars"))
    near = upto.where(F.col("upto") - F.col("n") < max_chars).select("paper_id", "chunk_id")
    # What is gathered per paper is at most max_chars and one chunk.
    joined = texts.join(near, ["paper_id", "chunk_id"]).groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("t"))
    return joined.join(total, "paper_id").select("paper_id", F.substring(F.array_join("t.text", "\n\n"), 1, max_chars).alias("text"), "total_chars")


def full_paper_context(index: Index, wanted: DataFrame, token_budget: int = 6000, latex: DataFrame | None = None) -> DataFrame:
    """(query_id, paper_rank, arxiv_id, mode, sent, sent_chars, total_chars, truncated): whole papers of queries, wanted (query_id, paper_rank, arxiv_id), in order and within budget."""
    rows = wanted.select(F.col("query_id").alias("session_id"), F.col("paper_rank").alias("seq"), "arxiv_id")
    out = chat_context(index, rows, token_budget, latex, 0)
    return out.withColumnRenamed("session_id", "query_id").withColumnRenamed("seq", "paper_rank")


def chat_context(index: Index, attached: DataFrame, token_budget: int = 6000, latex: DataFrame | None = None, least_chars: int = 1000) -> DataFrame:
    """(session_id, seq, arxiv_id, mode, sent, sent_chars, total_chars, truncated) of papers attached to sessions.

    attached is (session_id, seq, arxiv_id), latex (arxiv_id, text). A paper's
    LaTeX comes first, else all its chunks; a paper without text is left out.
    The budget is four characters a token, least_chars at least.
    """
    budget = max(least_chars, 4 * token_budget)
    ids = index.papers.groupBy("arxiv_id").agg(F.min("paper_id").alias("paper_id"))
    wanted = attached.select("session_id", "seq", "arxiv_id").join(ids, "arxiv_id", "left")
    chunks = paper_texts(index, budget, wanted).withColumnRenamed("text", "chunk_text").withColumnRenamed("total_chars", "chunk_chars")
    rows = wanted.join(chunks, "paper_id", "left")
    if latex is not None:
        rows = rows.join(latex.select("arxiv_id", F.trim("text").alias("latex_text")), "arxiv_id", "left")
    else:
        rows = rows.withColumn("latex_text", F.lit(None).cast("string"))
    has = F.length("latex_text") > 0
    rows = rows.withColumn("text", F.when(has, F.col("latex_text")).otherwise(F.col("chunk_text"))).withColumn("mode", F.when(has, "latex").otherwise("vectors"))
    rows = rows.withColumn("total_chars", F.when(has, F.length("latex_text").cast("long")).otherwise(F.col("chunk_chars"))).where(F.length("text") > 0)
    before = F.coalesce(F.sum("total_chars").over(Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_room", (F.lit(budget) - before).cast("int")).where("_room > 0")
    sent = F.substring(F.col("text"), F.lit(1), F.col("_room"))
    return rows.select(
        "session_id", "seq", "arxiv_id", "mode", sent.alias("sent"), F.length(sent).cast("long").alias("sent_chars"), "total_chars",
        (F.col("total_chars") > F.col("_room")).alias("truncated"),
    )


def context_dump(texts: DataFrame, text: str = "text", limit_chars: int | None = None) -> DataFrame:
    """texts with chars, full (the whole text or its first limit_chars) and truncated."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("long")
    full = F.coalesce(F.col(text), F.lit(""))
    full = F.substring(full, 1, limit_chars) if limit_chars else full
    return texts.withColumn("chars", n).withColumn("full", full).withColumn("truncated", F.length("full") < F.col("chars"))


def prompts(packed: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, prompt): intro, a [Source id] block for each packed paper, and the question."""
    block = F.format_string("[Source %s]\n%s\n\n", "arxiv_id", "sent")
    parts = packed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("paper_rank", block.alias("b")))).alias("t"))
    text = F.concat(F.lit(_INTRO), F.array_join("t.b", ""), F.lit("Question: "), "query", F.lit(_OUTRO))
    return parts.join(queries, "query_id").select("query_id", text.alias("prompt"))


def offline_summary(packed: DataFrame, max_chars: int = 900) -> DataFrame:
    """(query_id, summary): between an opening and a closing line a bullet for each of the first three blocks, white space collapsed, at most max_chars of each."""
    text = F.substring(F.trim(F.regexp_replace("sent", r"(?U)\s+", " ")), 1, max_chars)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("paper_rank"))
    first = packed.withColumn("_r", nth).where("_r <= 3").withColumn("_b", F.format_string("- [%s] %s...", F.col("arxiv_id"), text))
    lines = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("paper_rank", "_b"))).alias("t"))
    summary = F.concat_ws("\n", F.lit(_OFFLINE_HEAD), F.array_join("t._b", "\n"), F.lit(_OFFLINE_TAIL))
    return lines.select("query_id", summary.alias("summary"))


def previews(packed: DataFrame, head: int = 800) -> DataFrame:
    """(query_id, paper_rank, arxiv_id, chars, head) of packed blocks."""
    return packed.select("query_id", "paper_rank", "arxiv_id", F.length("sent").cast("long").alias("chars"), F.substring("sent", 1, head).alias("head"))


def public_ids(ids: DataFrame, papers: DataFrame) -> DataFrame:
    """ids (id string) with public_id: an id with a dot, a slash or a v stays, a number becomes the paper's arxiv_id if there is one."""
    numbered = papers.select(F.col("paper_id").cast("string").alias("id"), "arxiv_id")
    return ids.join(numbered, "id", "left").withColumn("public_id", F.when(F.col("id").rlike("[./v]"), F.col("id")).otherwise(F.coalesce("arxiv_id", "id"))).drop("arxiv_id")


def answer(prompt_rows: DataFrame, ask: Callable[[str], str]) -> list[tuple[str, str]]:
    """Answers (query_id, answer) by a callback, called on the driver for each prompt; for few prompts."""
    return [(r["query_id"], ask(r["prompt"])) for r in prompt_rows.toLocalIterator()]


def session_papers(events: DataFrame) -> DataFrame:
    """(session_id, seq, paper_id, mode): papers attached now, from events (session_id, seq, action, paper_id, mode).

    action is add, remove or clear. Adding a paper that is attached changes
    nothing; its seq is that of the add that counts. A mode other than latex,
    vectors and auto is latex.
    """
    clears = events.where("action = 'clear'").groupBy("session_id").agg(F.max("seq").alias("_clear"))
    removes = events.where("action = 'remove'").groupBy("session_id", "paper_id").agg(F.max("seq").alias("_remove"))
    adds = events.where("action = 'add' and paper_id is not null").join(clears, "session_id", "left").join(removes, ["session_id", "paper_id"], "left")
    floor = F.greatest(F.coalesce("_clear", F.lit(-1)), F.coalesce("_remove", F.lit(-1)))
    mode = F.lower(F.trim(F.coalesce("mode", F.lit("latex"))))
    mode = F.when(mode.isin("latex", "vectors", "auto"), mode).otherwise("latex")
    live = adds.where(F.col("seq") > floor).groupBy("session_id", "paper_id").agg(F.min(F.struct("seq", mode.alias("mode"))).alias("f"))
    return live.select("session_id", "f.seq", "paper_id", "f.mode")
