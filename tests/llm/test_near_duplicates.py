import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.operators import skew
from folioscan.llm.near_duplicates import NearDuplicates, brute_force_pairs, components, similar_sets


def shingles(text, k):
    w = re.findall(r"[^\W_]+", text.lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def texts(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            words = out[int(rng.integers(len(out)))].split()
            for _ in range(int(rng.integers(0, 4))):
                at = int(rng.integers(len(words)))
                words[at : at + int(rng.integers(0, 2))] = [str(rng.choice(vocabulary))]
        else:
            words = list(rng.choice(vocabulary[: 20 if rng.random() < 0.3 else 400], int(rng.integers(4, 120))))
        out.append(" ".join(words))
    return out


def test_pairs_equal_brute_force(spark):
    for seed, k, t in ((1, 3, 0.6), (2, 5, 0.8), (3, 3, 0.35)):
        rows = texts(seed)
        df = spark.createDataFrame(list(enumerate(rows)), "id long, text string")
        got = {(r.a, r.b) for r in NearDuplicates(df, "id", "text", k=k, threshold=t).pairs().collect()}
        assert got == brute_force_pairs({i: shingles(x, k) for i, x in enumerate(rows)}, t)


def test_hot_sets_in_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(skew, "BLOCK_ROWS", 7)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rows = texts(5, 90)
    rows += [rows[3]] * 25 + [rows[3] + f" w{i}" for i in range(25)]
    df = spark.createDataFrame([(i, t, i % 4) for i, t in enumerate(rows)], "id long, text string, paper_id long")
    found = NearDuplicates(df, "id", "text", k=3, threshold=0.6, keep=("paper_id",))
    want = brute_force_pairs({i: shingles(x, 3) for i, x in enumerate(rows)}, 0.6)
    got = [(r.a, r.b) for r in found.pairs().collect()]
    assert set(got) == want and len(got) == len(want)
    assert {(r.a, r.b) for r in found.pairs(different="paper_id").collect()} == {(a, b) for a, b in want if a % 4 != b % 4}
    links = {r.id: r.links for r in found.classes().collect()}
    assert all(n == sum(i in p for p in want) for i, n in links.items())


def test_boundary_only_moves_cost(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [set(rng.integers(0, 60, int(rng.integers(1, 30))).tolist()) for _ in range(80)]
    sets = [(i, len(s), sorted(s)) for i, s in enumerate(base)]
    df = spark.createDataFrame(sets, "id long, size int, shingles array<long>")
    want = brute_force_pairs({i: frozenset(s) for i, s in enumerate(base)}, 0.5)
    for limit in (0, 8, 1000):
        monkeypatch.setattr("folioscan.llm.near_duplicates._boundary", lambda _, limit=limit: limit)
        assert {(r.a, r.b) for r in similar_sets(df, 0.5).collect()} == want


def test_edges(spark):
    long = "x " * 50_000 + "end of it all"
    rows = [(1, "a b c d", 1), (1, "a b c d", 1), (2, "A, b; c d!", 2), (3, None, 3), (4, "", 4), (None, "a b c d", 5), (5, "a b", 6), (6, long, 7), (7, long, None)]
    df = spark.createDataFrame(rows, "id long, text string, paper_id long").selectExpr("*", "1 as rep", "2 as sig", "3 as size")
    found = NearDuplicates(df, "id", "text", k=3, threshold=0.6, keep=("paper_id",))
    assert {tuple(r) for r in found.pairs().collect()} == {(1, 2), (6, 7)}
    assert {tuple(r) for r in found.pairs(different="paper_id").collect()} == {(1, 2)}
    assert {tuple(r) for r in found.classes().collect()} == {(1, 1, 1), (2, 1, 1), (6, 6, 1), (7, 6, 1)}
    empty = NearDuplicates(df.where("false"), "id", "text", k=3)
    assert empty.pairs().count() == 0 and empty.classes().count() == 0


def test_copies_of_a_third_of_all(spark):
    rows = [(i, "the same text in very many papers at once" if i % 3 == 0 else f"text {i} of {i * 7} and {i * 11} only here") for i in range(600)]
    classes = NearDuplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", k=3, threshold=0.6).classes().collect()
    assert {(r.class_id, r.links) for r in classes if r.id % 3 == 0} == {(0, 199)}
    assert all(r.links == 0 and r.class_id == r.id for r in classes if r.id % 3)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), min_size=1, max_size=20))
def test_components(spark, edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
