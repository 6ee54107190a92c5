import random

import pytest

from folioscan.operators import context as C
from folioscan.operators import matching as M
from folioscan.operators import search as S
from folioscan.operators.indexing import index_from_tables
from folioscan.runtime import durable

TERMS = [f"term{chr(97 + i)}" for i in range(14)]


@pytest.fixture(scope="module")
def index(spark):
    """240 chunks of 24 papers, of which some are versions of one; the first terms are common, the last rare. Ids are far apart; many scores tie."""
    draw = random.Random(7)
    papers = [(i, f"07{i // 3:02d}.0001v{i % 3 + 1}" if i % 8 else None, f"title {i}", 2007, "p") for i in range(24)]
    chunks = [(i * i * 1000 + 1, i % 26, ("paragraph", "equation")[i % 3 == 0], f"text {i}", 1.0) for i in range(240)]
    postings = [(t, c[0], float(draw.choice((1, 1, 2, 5)))) for c in chunks for t in range(len(TERMS)) if draw.random() < 0.9 / (1 + t)]
    return index_from_tables(
        spark.createDataFrame(papers, "id long, arxiv_id string, title string, year int, path string"),
        spark.createDataFrame([(c[0], None if n % 50 == 0 else c[1], *c[2:]) for n, c in enumerate(chunks)], "id long, paper_id long, kind string, text string, norm double"),
        spark.createDataFrame([(i, t, 0) for i, t in enumerate(TERMS)], "id long, term string, df long"),
        spark.createDataFrame(postings, "token_id long, chunk_id long, tf double"),
    )


@pytest.fixture(scope="module")
def batch(spark):
    draw = random.Random(8)
    rows = [(f"q{i}", " ".join(draw.sample(TERMS, draw.randint(1, 9)))) for i in range(25)]
    return durable(spark.createDataFrame([*rows, (None, "terma termd"), ("unknown", "nothing")], "query_id string, query string"), "batch")


def in_blocks(monkeypatch, run):
    """The rows of run, by a row for each match and in small blocks, where no such rows may be made."""
    want = sorted(run().collect(), key=str)
    with monkeypatch.context() as m:
        m.setattr(S, "ROW_MATCHES", 0)
        m.setattr(M, "BLOCK_CHUNKS", 60)
        m.setattr(M, "QUERY_TOKENS", 40)
        m.setattr(S, "hits", None)
        m.setattr(C, "hits", None)
        return want, sorted(run().collect(), key=str)


@pytest.mark.parametrize("most, offset, kind", [(20, 7, "both"), (9, 3, "equation"), (9, 0, "no such")])
def test_candidates_in_blocks(index, batch, monkeypatch, most, offset, kind):
    o = S.SearchOptions(no_filter=True, max_candidates=most, offset=offset, kind=kind, top_m_tokens=5)
    vectors = durable(S.query_vectors(index, batch, o), "vectors")
    want, got = in_blocks(monkeypatch, lambda: S.candidates(index, vectors, o))
    assert got == want and (len(got) > 50 or kind == "no such")


def test_rag_context_in_blocks(index, batch, monkeypatch):
    want, got = in_blocks(monkeypatch, lambda: C.rag_context(index, batch, 12, 3, 2))
    assert got == want and len(got) > 50


def test_no_query_in_blocks(index, batch, monkeypatch):
    monkeypatch.setattr(S, "ROW_MATCHES", -1)
    assert C.rag_context(index, batch.where("query_id = 'unknown'")).count() == 0
    assert S.search(index, batch.where("query_id = 'unknown'")).count() == 0


@pytest.mark.parametrize(
    "options",
    [{"scoring": "bm25", "per_paper_k": 2, "top_k": 9}, {"max_candidates": 100, "offset": 30, "top_k": 5}, {"two_pass": True, "two_pass_top": 12}],
    ids=str,
)
def test_search_in_blocks(index, batch, monkeypatch, options):
    o = S.SearchOptions(no_filter=True, **options)
    want, got = in_blocks(monkeypatch, lambda: S.search(index, batch, o))
    assert got == want and len(got) > 90


def test_more_tokens_than_a_scan_can_list(index, batch, monkeypatch):
    monkeypatch.setattr(S, "LOOKUP_TOKENS", 2)
    want, got = in_blocks(monkeypatch, lambda: S.search(index, batch, S.SearchOptions(no_filter=True, top_k=3)))
    assert got == want and len(got) > 60


def test_only_what_can_rank_leaves_a_block(index, batch, monkeypatch):
    """No row for each candidate is made where a few rows of a block are all that can come out."""
    o = S.SearchOptions(no_filter=True, top_k=2).clamped()
    vectors = durable(S.query_vectors(index, batch, o), "vectors")
    monkeypatch.setattr(S, "ROW_MATCHES", 0)
    assert S.scored(index, vectors, o, cut=True).groupBy("query_id").count().where("count > 2").isEmpty()
    assert S.scored(index, vectors, o).groupBy("query_id").count().where("count > 90").count() > 10


def test_prompts_in_blocks(index, batch, monkeypatch):
    want, got = in_blocks(monkeypatch, lambda: C.prompts(C.rag_context(index, batch, 12, 3, 2), batch))
    assert got == want and len(got) == 25 and all(r.prompt.count("[Source ") for r in got)
