"""Latent-semantic vectors of chunks and queries, and word vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.operators.indexing import Index, idf
from folioscan.operators.skew import salted_join
from folioscan.runtime import broadcast_if_small, durable


def weighted_postings(index: Index, only: DataFrame | None = None) -> DataFrame:
    """(chunk_id, token_id, w): unit tf-idf rows of all chunks, or of those in only (chunk_id)."""
    postings = index.postings.select("chunk_id", "token_id", "tf")
    if only is not None:
        postings = postings.join(only, "chunk_id", "left_semi")
    known = index.tokens.where("df > 0").select("token_id", "df")
    joined = salted_join(postings, known, "token_id", known, count="df", measure=True)
    joined = joined.join(index.chunks.select("chunk_id", "norm"), "chunk_id")
    w = (1 + F.log("tf")) * idf(index.n_chunks, F.col("df"))
    return joined.select("chunk_id", "token_id", (w / F.col("norm")).alias("w"))


#: Rows or columns of one block of a sparse matrix, about.
BLOCK = 20_000
#: Tokens whose vectors one task can hold beside a block of chunks.
WIDE = 100_000
#: Entries whose vectors a task holds at once.
ENTRIES = 20_000


def product(entries: DataFrame, table: DataFrame, row: str, col: str, rows: int, cols: int) -> DataFrame:
    """(row, vec): for every row of a sparse matrix, entries (row, col, w), the sum of w * vec over its columns, table (col, vec).

    Entries and vectors meet in blocks of rows and columns, one task each, so
    neither side is ever held whole, and a row or column with very many entries is spread.
    """
    high, wide = -(-max(1, rows) // BLOCK), -(-max(1, cols) // BLOCK)

    def block(c: str, n: int) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    left = entries.select(F.col(row).alias("r"), F.col(col).alias("c"), F.col("w").cast("double").alias("w")).withColumn("i", block("r", high)).withColumn("j", block("c", wide))
    right = table.select(F.col(col).alias("c"), F.col("vec").cast("array<double>").alias("vec")).withColumn("j", block("c", wide))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"r": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64()))})
        vectors = b.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        names = b.column("c").to_numpy()
        order = np.argsort(names)
        names, vectors = names[order], vectors[order]
        r, c, w = (a.column(x).to_numpy() for x in ("r", "c", "w"))
        at = np.minimum(np.searchsorted(names, c), len(names) - 1)
        known = names[at] == c
        order = np.flatnonzero(known)[np.argsort(r[known], kind="stable")]
        return _rows(*_sums(r[order], w[order], vectors, at[order]))

    met = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(multiply, "r long, vec array<double>")
    if wide > 1:
        met = met.withColumn("i", block("r", high)).groupBy("i").applyInArrow(_add, "r long, vec array<double>")
    return met.withColumnRenamed("r", row)


def _sums(r: np.ndarray, w: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of r, which is in order, and for each the sum of w times the vector at at."""
    out, start = np.unique(r, return_index=True)
    sums = np.zeros((len(out), vectors.shape[1]))
    slot = np.repeat(np.arange(len(out)), np.diff(np.append(start, len(r))))
    for s in range(0, len(r), ENTRIES):
        part = slice(s, s + ENTRIES)
        own, first = np.unique(slot[part], return_index=True)
        sums[own] += np.add.reduceat(w[part, None] * vectors[at[part]], first, axis=0)
    return out, sums


def _squared(entries: DataFrame, basis: DataFrame, chunks: int, tokens: int) -> DataFrame:
    """(token_id, vec): the product of the transposed matrix, the matrix and basis.

    While the vectors of all tokens fit a task, each block of chunks takes both
    steps at once and sends its sums by token; beyond, the rows between the steps become a table.
    """
    if tokens > WIDE:
        image = durable(product(entries, basis, "chunk_id", "token_id", chunks, tokens), "latent-rows")
        return product(entries, image, "token_id", "chunk_id", tokens, chunks)
    high = -(-max(1, chunks) // BLOCK)
    left = entries.select("chunk_id", "token_id", "w").withColumn("i", F.pmod(F.xxhash64("chunk_id"), F.lit(high)).cast("int"))
    right = basis.select("token_id", "vec").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))

    def both(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"r": pa.array([], pa.int64()), "vec": pa.array([], pa.list_(pa.float64()))})
        vectors = b.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        order = np.argsort(b.column("token_id").to_numpy())
        names, vectors = b.column("token_id").to_numpy()[order], vectors[order]
        chunk, token, w = (a.column(x).to_numpy() for x in ("chunk_id", "token_id", "w"))
        order = np.argsort(chunk, kind="stable")
        ids, image = _sums(chunk[order], w[order], vectors, np.searchsorted(names, token[order]))
        order = np.argsort(token, kind="stable")
        return _rows(*_sums(token[order], w[order], image, np.searchsorted(ids, chunk[order])))

    parts = left.groupBy("i").cogroup(right.groupBy("i")).applyInArrow(both, "r long, vec array<double>")
    if high > 1:
        spread = F.pmod(F.xxhash64("r"), F.lit(-(-max(1, tokens) // BLOCK) * 8)).cast("int")
        parts = parts.withColumn("i", spread).groupBy("i").applyInArrow(_add, "r long, vec array<double>")
    return parts.withColumnRenamed("r", "token_id")


def _rows(ids: np.ndarray, vectors: np.ndarray) -> pa.Table:
    offsets = np.arange(len(ids) + 1, dtype=np.int32) * np.int32(vectors.shape[1])
    return pa.table({"r": pa.array(ids), "vec": pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))})


def _add(parts: pa.Table) -> pa.Table:
    """The sum of vectors of each row."""
    r = parts.column("r").to_numpy()
    order = np.argsort(r, kind="stable")
    vectors = parts.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(r), -1)[order]
    out, start = np.unique(r[order], return_index=True)
    return _rows(out, np.add.reduceat(vectors, start, axis=0))


def _map_vectors(df: DataFrame, key: str, run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """df (key, vec) with run(keys, vectors) in place of vec, batch by batch."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                made = _rows(batch.column(key).to_numpy(), run(batch.column(key).to_numpy(), vectors))
                yield from made.rename_columns([key, "vec"]).to_batches()

    return df.select(key, "vec").mapInArrow(step, f"{key} long, vec array<double>")


def _gram(df: DataFrame, width: int) -> np.ndarray:
    """The sum of vec times its transpose over all rows: width times width numbers, added up in the tasks first."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total += x.T @ x
        yield from _rows(np.arange(width), total).to_batches()

    partial = df.select("vec").mapInArrow(step, "r long, vec array<double>")
    summed = partial.groupBy(F.pmod("r", F.lit(8)).alias("i")).applyInArrow(_add, "r long, vec array<double>").collect()
    out = np.zeros((width, width))
    for row in summed:
        out[row["r"]] = row["vec"]
    return out


def _signs(keys: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Random signs that depend on key and column only."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.where((x >> np.uint64(63)).astype(bool), 1.0, -1.0)


def fit_svd(index: Index, k: int = 128, fit_rows: int = 100_000, rounds: int = 4, extra: int = 10, seed: int = 42) -> DataFrame:
    """(token_id, component): the right singular vectors of tf-idf rows, at most k numbers a token, by falling singular value.

    Fitted on at most fit_rows chunks, those of least id hash; every chunk is
    transformed. Not centred. Randomised subspace iteration: random signs, rounds
    times the products with the matrix and its transpose, made orthonormal each
    time, then the singular vectors within that subspace. The components stay a
    table; the driver sees k + extra squared numbers. Tokens of no fitted chunk have no row.
    """
    sample = index.chunks.select("chunk_id").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(fit_rows)
    sample = broadcast_if_small(durable(sample, "fit-chunks"))
    entries = durable(weighted_postings(index, sample), "fit-entries")
    used = durable(entries.groupBy("token_id").agg(F.count(F.lit(1)).alias("n")), "fit-tokens")
    tokens, chunks = used.count(), min(fit_rows, index.n_chunks)
    width = max(1, min(k + extra, tokens))
    start = used.select("token_id", F.array(F.lit(0.0)).alias("vec"))
    basis = _map_vectors(start, "token_id", lambda keys, _: _signs(keys, width, seed))
    for _ in range(rounds):
        raw = durable(_squared(entries, basis, chunks, tokens), "latent-columns")
        for _ in range(2):  # once more for the rounding of nearly dependent columns
            value, vector = np.linalg.eigh(_gram(raw, width))
            good = value > max(value.max(initial=0.0), 1e-300) * 1e-13
            turn = vector[:, good] / np.sqrt(value[good])
            width = int(good.sum())
            raw = _map_vectors(raw, "token_id", lambda _, x, turn=turn: x @ turn)
            if not width:
                return raw.select("token_id", F.col("vec").alias("component"))
        basis = durable(raw, "latent-basis")
    image = product(entries, basis, "chunk_id", "token_id", chunks, tokens)
    value, vector = np.linalg.eigh(_gram(image, width))
    turn = vector[:, np.argsort(-value)[:k]]
    return _map_vectors(basis, "token_id", lambda _, x: x @ turn).select("token_id", F.col("vec").alias("component"))


def _unit(df: DataFrame, key: str, out: str) -> DataFrame:
    """Vectors at length 1; one of zeros stays so."""
    unit = _map_vectors(df, key, lambda _, x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300))
    return unit.select(key, F.col("vec").alias(out))


def embed_chunks(index: Index, components: DataFrame) -> DataFrame:
    """(chunk_id, v): unit latent vectors of all chunks that hold a token with a component."""
    vectors = components.select("token_id", F.col("component").alias("vec"))
    return _unit(product(weighted_postings(index), vectors, "chunk_id", "token_id", index.n_chunks, components.count()), "chunk_id", "v")


def embed_queries(vectors: DataFrame, components: DataFrame) -> DataFrame:
    """(query_id, qv): unit latent vectors of query vectors (query_id, token_id, q)."""
    weights = vectors.select("query_id", "token_id", F.col("q").alias("w"))
    table = components.select("token_id", F.col("component").alias("vec"))
    table = table.join(broadcast_if_small(durable(weights.select("token_id").distinct(), "query-tokens")), "token_id", "left_semi")
    return _unit(product(weights, table, "query_id", "token_id", 1, 1), "query_id", "qv")


def fit_word_vectors(tokens: DataFrame, column: str = "tokens", size: int = 200, window: int = 8, min_count: int = 3, epochs: int = 5, seed: int = 42) -> Word2VecModel:
    """Skip-gram word vectors of token lists; null lists are left out."""
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=epochs, seed=seed, inputCol=column, outputCol="w2v")
    return model.fit(tokens.where(F.col(column).isNotNull()).select(column))
