import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.llm import sizes
from folioscan.llm.distinctive import distinctive_terms
from folioscan.llm.mixing import SourceMix, fit_budget, subset_sum
from folioscan.llm.packing import pack, plan_containers
from folioscan.llm.term_counts import term_counts


def test_token_count(spark):
    texts = ["a_b c1-d", "", None, "   \n", "x² ½ é́ 漢字!", "\U0001d54f\U0001f600", "a b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(sizes.token_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]", t or "")) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plan_uses_every_item_once(hist):
    used = {}
    for reps, pattern in plan_containers(hist, 64):
        assert reps > 0 and sum(a * b for a, b in pattern) <= 64
        for length, times in pattern:
            used[length] = used.get(length, 0) + reps * times
    assert used == hist


def test_plan_fills_well():
    rng = np.random.default_rng(1)
    values, counts = np.unique(np.minimum(2048, rng.lognormal(5.3, 1.1, 50_000).astype(int) + 1), return_counts=True)
    plan = plan_containers(dict(zip(values.tolist(), counts.tolist())), 2048)
    assert (values * counts).sum() / (2048 * sum(r for r, _ in plan)) > 0.995


def test_pack_rows(spark, monkeypatch):
    monkeypatch.setattr(sizes, "RANK_ROWS", 50)
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * (7 if i % 3 == 0 else int(rng.integers(0, 90))))) for i in range(500)] + [(1000, "w " * 100_000), (1001, None), (1001, None), (None, "w")]
    out = pack(spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 as rank", "2 as length"), "id", "text", 32).toPandas()
    placed = out.dropna(subset=["container_id"])
    assert placed.groupby("container_id")["length"].sum().max() <= 32
    whole = out.groupby("id").agg(n=("n_tokens", "first"), s=("length", "sum"), p=("piece_no", "count"))
    want = {i: len(t.split()) if t else 0 for i, t in rows if i is not None}
    assert {i: r.n for i, r in whole.iterrows()} == want
    assert all(whole.loc[i].s == n and whole.loc[i].p == max(1, -(-n // 32)) for i, n in want.items() if i != 1001)
    assert len(out[out.id == 1001]) == 2 and out[out.length == 0]["container_id"].isna().all()
    assert placed["length"].sum() / (32 * placed["container_id"].nunique()) > 0.97
    assert pack(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_subset_sum(items, target):
    best = {0}
    for n, c in items:
        best = {s + n * k for s in best for k in range(c + 1) if s + n * k <= target}
    got = subset_sum([n for n, _ in items], [c for _, c in items], target)
    assert all(got[n] <= dict(items)[n] for n in got) and sum(n * k for n, k in got.items()) == max(best)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 500), st.integers(1, 2000), min_size=3, max_size=30), st.floats(0, 1.2))
def test_fit_budget(hist, part):
    total = sum(a * b for a, b in hist.items())
    budget = int(total * part)
    got = fit_budget(list(hist), list(hist.values()), budget, 256)
    assert all(0 <= got.get(n, 0) <= c for n, c in hist.items())
    assert sum(n * k for n, k in got.items()) <= budget


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(sizes, "RANK_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), [" Big", "small ", None, "other"][0 if i % 3 else 1 + i % 9 // 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.3, 2), ("small", 0.2, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mix = SourceMix(docs, targets, "doc_id", "text", "source")
    shares = {r.source: r for r in mix.shares().collect()}
    total = sum(len(t.split()) for _, t, _ in rows)
    assert mix.total == total and shares["none"].short and shares["none"].used_tokens == 0
    for s, most, share in (("big", 2, 0.3), ("small", 4, 0.2)):
        own = sum(len(t.split()) for _, t, x in rows if x and x.strip().lower() == s)
        assert shares[s].available_tokens == own and shares[s].short == (most * own < share * total)
        assert shares[s].used_tokens == int(min(share * total, most * own))
    used = mix.documents().groupBy("source").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("n"), F.max("times").alias("m")).collect()
    assert {r.source: r.n for r in used} == {s: shares[s].used_tokens for s in ("big", "small")} and all(r.m <= 4 for r in used)
    empty = SourceMix(docs.where("false"), targets, "doc_id", "text", "source")
    assert empty.documents().count() == 0 and empty.shares().count() == 3


def facts(seed=5):
    rng = np.random.default_rng(seed)
    rows = {(int(t), int(c)): float(rng.integers(1, 5)) for t, c in zip(np.minimum(rng.zipf(1.3, 4000), 200), rng.integers(0, 150, 4000))}
    return [(t, c, tf) for (t, c), tf in rows.items()]


@pytest.mark.parametrize("share", [1 / 512, 0.05, 2.0])
def test_term_counts(spark, share):
    rows = facts()
    names = [(t, ["Térm", "térm "][t % 2] if t < 4 else f"t{t}") for t in range(1, 190)] + [(5, "t5"), (7, None), (None, "x")]
    posting = spark.createDataFrame(rows + rows[:500] + [(None, 999, 1.0), (3, None, 1.0), (5, 150, None)], "token_id long, chunk_id long, tf double")
    token = spark.createDataFrame(names, "id long, term string").selectExpr("*", "1L as df", "2 as slot")
    got = {r.term: (r.chunks, r.total_tf, r.band) for r in term_counts(posting, token, heavy_share=share).collect()}
    chunks, total = {}, {}
    for t, c, tf in [*rows, (5, 150, 0.0)]:
        if t < 190 and t != 7 or t == 7:
            name = "térm" if t < 4 else f"t{t}"
            if t >= 190:
                continue
            chunks.setdefault(name, set()).add(c)
            total[name] = total.get(name, 0) + tf
    n = len({c for _, c, _ in rows} | {999, 150})
    want = {t: (len(c), total[t], "rare" if len(c) <= 2 else "common" if len(c) >= 0.15 * n else "useful") for t, c in chunks.items()}
    assert got == want


def test_distinctive_edges(spark):
    rows = facts(6)
    posting = spark.createDataFrame(rows + rows[:300] + [(None, 1, 1.0), (2, None, 1.0), (9, 3000, None), (9, 3001, 0.0)], "token_id long, chunk_id long, tf double")
    got = distinctive_terms(posting.selectExpr("*", "1 as weight", "2 as df")).collect()
    assert len(got) == len(rows)
    squares = {}
    for r in got:
        squares[r.chunk_id] = squares.get(r.chunk_id, 0) + r.share**2
        assert r.ppmi >= 0 and r.weight > 0
    assert all(abs(s - 1) < 1e-9 for s in squares.values())
    nine = next(r for r in got if r.token_id == 9)
    assert nine.df == len({c for t, c, _ in rows if t == 9}) + 2
    assert distinctive_terms(posting.where("false")).count() == 0


def test_fit_budget_takes_long_documents():
    assert fit_budget([40_000], [3], 45_000) == {40_000: 1}
    assert fit_budget([300_000], [3], 600_000) == {300_000: 2}
