import numpy as np

from folioscan.llm import vectors
from folioscan.llm.vectors import Codebooks, VectorIndex

SCHEMA = "id long, v array<float>"


def data(n=3000, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(40, dims))
    x = centers[rng.integers(0, 40, n)] + 0.6 * rng.normal(size=(n, dims))
    near = rng.choice(n, n // 10, replace=False)
    x[near] = x[(near * 7) % n] + 0.05 * rng.normal(size=(len(near), dims))
    return (x * rng.lognormal(0, 1, (n, 1))).astype(np.float32)


def exact(x, k):
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_codes_improve_with_books():
    x = data()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    errors = []
    for books in (1, 3, 6):
        c = Codebooks.fit(x, 8, books, 32)
        errors.append(float(((x - c.decode(c.encode(x))) ** 2).sum(1).mean()))
    assert errors[0] > errors[1] > errors[2]
    codes = c.encode(x[:50])
    cell = int(codes[0, 0])
    own = codes[codes[:, 0] == cell]
    assert np.allclose(c.table_scores(x[:5], cell, own[:, 1:]), x[:5] @ c.decode(own).T, atol=1e-4)


def test_recall_and_close_pairs(spark):
    x = data()
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)]
    index = VectorIndex(spark.createDataFrame(rows, SCHEMA), "id", "v", dims=16, cell_rows=150)
    sims, top = exact(x, 10)
    got = {}
    for r in index.nearest(10).collect():
        got.setdefault(r.id // 3, []).append(r.other // 3)
    assert len(got) == len(x) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(got[i]) & set(top[i])) / 10 for i in range(len(x))]) >= 0.9
    want = {(min(i, j), max(i, j)) for i in range(len(x)) for j in top[i] if sims[i, j] >= 0.9}
    found = {(min(r.id, r.other) // 3, max(r.id, r.other) // 3) for r in index.close(0.9).collect()}
    assert len(found & want) / len(want) >= 0.95 and all(sims[i, j] >= 0.9 - 1e-6 for i, j in found)


def test_unusable_rows_and_copies(spark):
    x = data(400)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += rows[:40] + [(1000 + i, x[0].tolist()) for i in range(200)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [1.0] * 8), (2003, [float("nan")] * 16), (2004, [float("inf")] + [0.0] * 15), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as h", "2 as cell")
    near = VectorIndex(df, "id", "v", dims=16, cell_rows=50).nearest(5, spark.createDataFrame([(0,), (1100,), (7,), (2000,)], "id long")).collect()
    by = {}
    for r in sorted(near, key=lambda r: r["rank"]):
        by.setdefault(r.id, []).append(r.other)
    assert set(by) == {0, 7, 1100} and all(len(v) == 5 and k not in v for k, v in by.items())
    assert by[0] == [1000, 1001, 1002, 1003, 1004] and by[1100] == [0, 1000, 1001, 1002, 1003]
    none = VectorIndex(df.where("id = 2000"), "id", "v", dims=16)
    assert none.nearest(5).count() == 0 and none.close(0.9).count() == 0


def test_full_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 60)
    monkeypatch.setattr(vectors, "QUERY_ROWS", 150)
    x = data(1200, seed=3)
    x[:500] = x[0] + 0.08 * np.abs(x[0]).max() * np.random.default_rng(1).normal(size=(500, 16)).astype(np.float32)
    index = VectorIndex(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), "id", "v", dims=16, cell_rows=200)
    _, top = exact(x, 10)
    got = {}
    for r in index.nearest(10).collect():
        got.setdefault(r.id, set()).add(r.other)
    assert np.mean([len(got[i] & set(top[i])) / 10 for i in range(len(x))]) >= 0.9


def test_dense_group_over_many_cells_is_whole(spark):
    x = data(3000, dims=32, seed=4)
    rng = np.random.default_rng(2)
    x[:1000] = x[0] / np.linalg.norm(x[0]) + 0.05 * rng.normal(size=(1000, 32))
    index = VectorIndex(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), "id", "v", dims=32, cell_rows=15)
    sims, top = exact(x, 10)
    assert 0.85 < np.median(sims[:1000, :1000]) < 0.97
    want = {(i, j) for i in range(len(x)) for j in top[i].tolist() if sims[i, j] >= 0.9}
    assert {(r.id, r.other) for r in index.close(0.9).collect()} == want
    few = spark.createDataFrame([(i,) for i in range(0, 3000, 10)], "id long")
    got = {(r.id, r.other) for r in index.nearest(10, few, probes=1).collect()}
    assert got == {(i, j) for i in range(0, 3000, 10) for j in top[i].tolist()}


def test_full_cells_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 60)
    monkeypatch.setattr(vectors, "SUB_PROBES", 1)
    x = data(1200, seed=3)
    index = VectorIndex(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), "id", "v", dims=16, cell_rows=400)
    sims, top = exact(x, 10)
    assert {(r.id, r.other) for r in index.nearest(10).collect()} == {(i, j) for i in range(len(x)) for j in top[i].tolist()}
    assert {(r.id, r.other) for r in index.close(0.9).collect()} == {(i, j) for i in range(len(x)) for j in top[i].tolist() if sims[i, j] >= 0.9}


def shuffled_rows(spark):
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_many_blocks_are_compared_without_copies(spark, monkeypatch):
    monkeypatch.setattr(vectors, "GROUP_ROWS", 60)
    x = data(3000, dims=32, seed=4)
    x[:1000] = x[0] / np.linalg.norm(x[0]) + 0.05 * np.random.default_rng(2).normal(size=(1000, 32))
    index = VectorIndex(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), "id", "v", dims=32, cell_rows=15)
    sims, top = exact(x, 10)
    index.encoded().count()
    before = shuffled_rows(spark)
    pairs = {(r.a, r.b) for r in index.whole(10, 0.9).collect()}
    assert shuffled_rows(spark) - before < 2 * len(x), "with 50 blocks or more a vector is sent once"
    want = {(i, j) for i in range(len(x)) for j in top[i].tolist() if sims[i, j] >= 0.9}
    assert want <= pairs and len(pairs) < 1.1 * len(want)
    assert {(r.id, r.other) for r in index.close(0.9).collect()} == want
