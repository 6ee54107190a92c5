import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.operators import context as C
from folioscan.operators import latent as L
from folioscan.operators import search as S
from folioscan.operators import indexing
from folioscan.operators.indexing import Index, IndexReader, current, extend, index_from_chunks, publish
from folioscan.runtime import durable

TEXTS = [
    ("0704.0001v1", "chunk_0", "paragraph", "open sets cover compact spaces"),
    ("0704.0001v1", "chunk_1", "paragraph", "compact operators on open balls of compact spaces"),
    ("0704.0001v2", "chunk_0", "Paragraph ", "open sets cover compact spaces again"),
    ("0705.0002", "chunk_0", "paragraph", "prime ideals of noetherian rings"),
    ("0705.0002", "chunk_1", "equation", "$a + b$"),
    ("0706.0003", "chunk_0", "paragraph", "rings spaces ideals compact"),
    ("0707.0004", "chunk_0", "paragraph", "zeta"),
]


@pytest.fixture(scope="module")
def index(spark):
    rows = [(a, i, k, t, t.replace("$", "").split()) for a, i, k, t in TEXTS]
    rows += [rows[0], ("0708.0005", "chunk_0", "paragraph", "no tokens", []), (None, "chunk_0", "paragraph", "lost", ["lost"])]
    return index_from_chunks(spark.createDataFrame(rows, "arxiv_id string, id string, kind string, text string, tokens array<string>"))


def test_index_tables(index):
    assert index.n_chunks == len(TEXTS) and index.postings.count() == sum(len(set(t.split())) for *_, t in TEXTS)
    df = {r.term: r.df for r in index.tokens.collect()}
    assert df["compact"] == 4 and df["zeta"] == 1 and "lost" not in df
    words = TEXTS[1][3].split()
    n = len(TEXTS)
    norm = math.sqrt(sum(((1 + math.log(c)) * (math.log((1 + n) / (1 + df[w])) + 1)) ** 2 for w, c in Counter(words).items()))
    row = index.chunks.where("text like '%balls%'").first()
    assert row.norm == pytest.approx(norm) and row.dl == len(words)


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_scores_by_hand(spark, index):
    o = S.SearchOptions(no_filter=True, per_paper_k=9)
    got = {r.chunk_id: (r.cosine, r.bm25) for r in S.search(index, queries(spark, "compact zeta unknown"), o).collect()}
    n, avgdl = index.n_chunks, index.avgdl
    idf = {w: math.log((1 + n) / (1 + d)) + 1 for w, d in (("compact", 4), ("zeta", 1))}
    q = {w: v / math.sqrt(sum(x * x for x in idf.values())) for w, v in idf.items()}
    c = index.chunks.where("text like '%balls%'").first()
    dot = q["compact"] * (1 + math.log(2)) * idf["compact"]
    assert got[c.chunk_id][0] == pytest.approx(dot / c.norm, abs=1e-8)
    bm = math.log(1 + (n - 4 + 0.5) / 4.5) * 2.2 * 2 / (2 + 1.2 * (0.25 + 0.75 * c.dl / avgdl))
    assert got[c.chunk_id][1] == pytest.approx(bm, abs=1e-8)


def test_self_match_and_versions(spark, index):
    rows = S.search(index, queries(spark, "zeta", None, "", "qqqq"), S.SearchOptions()).collect()
    assert [(r.query_id, r.paper_id) for r in rows] == [(0, "0707.0004")] and rows[0].cosine == pytest.approx(1.0)
    many = S.search(index, queries(spark, "compact spaces"), S.SearchOptions(no_filter=True)).collect()
    bases = [r.paper_id.split("v")[0] for r in many]
    assert len(bases) == len(set(bases)) == 2
    more = S.search(index, queries(spark, "compact spaces"), S.SearchOptions(no_filter=True, per_paper_k=2)).collect()
    assert Counter(r.paper_id.split("v")[0] for r in more)["0704.0001"] == 2


def test_order_of_chunks_does_not_matter(spark, index):
    rows = [(a, i, k, t, t.replace("$", "").split()) for a, i, k, t in reversed(TEXTS)]
    other = index_from_chunks(spark.createDataFrame(rows, "arxiv_id string, id string, kind string, text string, tokens array<string>").repartition(7))
    q = queries(spark, "compact ideals of rings")
    assert S.search(index, q).orderBy("position").collect() == S.search(other, q).orderBy("position").collect()


def test_filters(spark, index):
    o = S.SearchOptions(min_keep=3)
    terms = {r.term for r in S.query_vectors(index, queries(spark, "the compact zeta of ideals nowhere elsewhere"), o).collect()}
    assert "compact" not in terms and "zeta" in terms and "the" not in terms
    lone = {r.term for r in S.query_vectors(index, queries(spark, "compact"), o).collect()}
    assert lone == {"compact"}
    none = S.query_vectors(index, queries(spark, "compact qq1 qq2 qq3"), o)
    assert none.count() == 0, "unknown terms count as kept, so the common one is not brought back"
    budget = S.query_vectors(index, queries(spark, "zeta ideals rings spaces"), S.SearchOptions(scan_budget=1, no_filter=True)).where("chosen").collect()
    assert [r.term for r in budget] == ["zeta"]


def test_two_pass_and_paging(spark, index):
    q = queries(spark, "compact spaces open ideals rings")
    o = S.SearchOptions(no_filter=True, two_pass=True, two_pass_top=2, per_paper_k=9)
    rows = S.search(index, q, o).orderBy("position").collect()
    first = sorted(rows, key=lambda r: (-r.bm25, r.chunk_id))
    head = sorted(first[:2], key=lambda r: (-r.cosine, first.index(r)))
    assert [r.chunk_id for r in rows] == [r.chunk_id for r in head + first[2:]]
    with pytest.raises(AssertionError):
        assert S.SearchOptions(top_k=0).clamped().top_k == 0
    assert S.SearchOptions(top_k=10**9, max_candidates=5, svd_alpha=0).clamped() == S.SearchOptions(top_k=5000, max_candidates=100, svd_alpha=0.5)
    merged = S.SearchOptions().merged({"bm25K1": 2.0, "perPaper": 3, "k1": 9.0, "max_df": 1, "nonsense": 1})
    assert merged == S.SearchOptions(k1=2.0, per_paper_k=3)


def test_context(spark, index):
    q = queries(spark, "compact prime")
    chosen = C.rag_select(index, q, 2, 1).orderBy("paper_rank").collect()
    assert [r.chunk_rank for r in chosen] == [1, 1] and len({r.paper_id for r in chosen}) == 2
    wanted = spark.createDataFrame([(0, 1, "0706.0003"), (0, 2, "0705.0002"), (0, 3, "none")], "query_id long, pos int, arxiv_id string")
    assert [r.arxiv_id for r in C.rag_select(index, q, 5, 5, wanted).where("chunk_rank = 1").orderBy("paper_rank").collect()] == ["0706.0003", "0705.0002"]
    packed = C.rag_context(index, q, token_budget=10).orderBy("paper_rank").collect()
    assert sum(r.sent_chars for r in packed) == 40 and packed[-1].truncated
    assert "[Source " in C.prompts(C.rag_context(index, q), q).first().prompt
    assert C.offline_summary(C.rag_context(index, q)).first().summary.split("\n")[2].startswith("- [")
    assert C.answer(C.prompts(C.rag_context(index, q), q), len)[0][1] > 100


def test_paper_texts_and_sessions(spark, index):
    texts = {r.paper_id: r for r in C.paper_texts(index, 40).collect()}
    one = index.papers.where("arxiv_id = '0704.0001v1'").first().paper_id
    whole = "\n\n".join(t for a, _, _, t in TEXTS if a == "0704.0001v1")
    assert texts[one].text == whole[:40] and texts[one].total_chars == len(whole)
    events = [("s", 1, "add", "a", "latex"), ("s", 2, "add", "b", "x"), ("s", 3, "add", "a", "auto"), ("s", 4, "remove", "b", None), ("s", 5, "add", "b", "vectors"), ("t", 1, "add", "a", None), ("t", 2, "clear", None, None)]
    df = spark.createDataFrame(events, "session_id string, seq int, action string, paper_id string, mode string")
    assert {tuple(r) for r in C.session_papers(df).collect()} == {("s", 1, "a", "latex"), ("s", 5, "b", "vectors")}
    attached = spark.createDataFrame([("s", 1, "0704.0001v1"), ("s", 2, "0705.0002"), ("s", 3, "none")], "session_id string, seq int, arxiv_id string")
    latex = spark.createDataFrame([("0705.0002", "z" * 2000)], "arxiv_id string, text string")
    rows = C.chat_context(index, attached, 10, latex).orderBy("seq").collect()
    assert [(r.mode, r.sent_chars, r.truncated) for r in rows] == [("vectors", len(whole), False), ("latex", 1000 - len(whole), True)]
    dump = C.context_dump(latex, limit_chars=5).first()
    assert (dump.full, dump.chars, dump.truncated) == ("zzzzz", 2000, True)


def test_full_papers_and_sql(spark, index):
    wanted = spark.createDataFrame([(0, 1, "0705.0002"), (0, 2, "0704.0001v1")], "query_id long, paper_rank int, arxiv_id string")
    rows = C.full_paper_context(index, wanted, 12).orderBy("paper_rank").collect()
    assert [(r.arxiv_id, r.sent_chars, r.truncated) for r in rows] == [("0705.0002", 41, False), ("0704.0001v1", 7, True)]
    index.register("ix_")
    assert spark.sql("select count(*) from ix_postings join ix_tokens using (token_id) where term = 'compact'").first()[0] == 4


def test_latent(spark, index, monkeypatch):
    rows = L.weighted_postings(index).collect()
    names = {t: i for i, t in enumerate(sorted({r.token_id for r in rows}))}
    chunks = {c: i for i, c in enumerate(sorted({r.chunk_id for r in rows}))}
    a = np.zeros((len(chunks), len(names)))
    for r in rows:
        a[chunks[r.chunk_id], names[r.token_id]] = r.w
    assert np.allclose(np.linalg.norm(a, axis=1), 1)
    singular = np.linalg.svd(a)[1][:3]
    for block, wide, rounds in ((4, 2, 1), (4, 100, 1), (20_000, 100, 8)):
        monkeypatch.setattr(L, "BLOCK", block)
        monkeypatch.setattr(L, "WIDE", wide)
        components = durable(L.fit_svd(index, 3, rounds=rounds))
        got = np.zeros((len(names), 3))
        for r in components.collect():
            got[names[r.token_id]] = r.component
        assert np.allclose(got.T @ got, np.eye(3), atol=1e-8)
        # Vectors of one singular value may turn within their subspace; what they hold of the matrix may not change.
        assert np.allclose(np.linalg.norm(a @ got, axis=0), singular, atol=1e-6 if rounds > 1 else 0.05)
        embedded = {r.chunk_id: r.v for r in L.embed_chunks(index, components).collect()}
        for c, i in chunks.items():
            image = a[i] @ got
            assert np.allclose(embedded[c], image / max(np.linalg.norm(image), 1e-300), atol=1e-8)
    o = S.SearchOptions(svd=True, no_filter=True)
    q = queries(spark, "compact spaces")
    latent = L.embed_queries(S.query_vectors(index, q, o), components), L.embed_chunks(index, components)
    assert S.search(index, q, o, latent).count() == S.search(index, q, S.SearchOptions(no_filter=True)).count()


def test_search_reads_the_folders_of_its_tokens_only(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(indexing, "PART_ROWS", 2)
    rows = [(a, i, k, t, t.replace("$", "").split()) for a, i, k, t in TEXTS]
    small = index_from_chunks(spark.createDataFrame(rows, "arxiv_id string, id string, kind string, text string, tokens array<string>"))
    assert small.parts > 5
    small.save(str(tmp_path / "ix"))
    stored = Index.load(spark, str(tmp_path / "ix"))
    one = stored.tokens.where("term = 'zeta'").first().token_id
    plan = stored.postings_of([one])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan.replace("PartitionFilters: [part", "PartitionFilters: [isnotnull(part") and "PushedFilters" in plan
    assert len(stored.postings_of([one]).select("token_id").inputFiles()) == len(stored.postings.inputFiles())
    read = {r[0] for r in stored.postings_of([one]).select(F.input_file_name()).collect()}
    assert len(read) == 1 < len(stored.postings.inputFiles())
    q = queries(spark, "compact zeta rings")
    o = S.SearchOptions(no_filter=True, per_paper_k=9)
    want = S.search(stored, q, o).orderBy("position").collect()
    monkeypatch.setattr(S, "LOOKUP_TOKENS", 1)
    assert S.search(stored, q, o).orderBy("position").collect() == want and len(want) > 3
    # The two-step way: candidates first, then scores of these.
    vectors = S.query_vectors(stored, q, o)
    assert {r.chunk_id for r in S.candidates(stored, vectors, o).collect()} == {r.chunk_id for r in want}


def test_time_limit(spark, index):
    q = queries(spark, "compact spaces")
    assert S.search(index, q, S.SearchOptions(time_limit=600)).count() == S.search(index, q).count()
    with pytest.raises(TimeoutError):
        S.search(index, q, S.SearchOptions(time_limit=1e-3))


def test_extend_equals_a_build_of_all(spark, index):
    rows = [(a, i, k, t, t.replace("$", "").split()) for a, i, k, t in TEXTS]
    schema = "arxiv_id string, id string, kind string, text string, tokens array<string>"
    every = spark.createDataFrame(rows, schema)
    grown = extend(index_from_chunks(every.where("arxiv_id < '0706'")), every)
    assert (grown.n_chunks, grown.avgdl) == (index.n_chunks, index.avgdl)
    assert {(r.term, r.df) for r in grown.tokens.collect()} == {(r.term, r.df) for r in index.tokens.collect()}
    facts = lambda ix: {(r.text, round(r.norm, 9), r.dl) for r in ix.chunks.collect()}
    assert facts(grown) == facts(index)
    assert extend(grown, every).n_chunks == grown.n_chunks


def test_versions(spark, index, tmp_path):
    root = str(tmp_path)
    publish(index, root)
    reader = IndexReader(spark, root)
    assert reader.get() is reader.get() and reader.get().n_chunks == index.n_chunks
    first = current(spark, root)
    publish(index, root)
    assert current(spark, root) != first and isinstance(reader.get(), Index)
    assert reader.get().postings.where(F.col("token_id") == 1).count() == index.postings.where("token_id = 1").count()
