"""Candidates of a large batch of queries, counted and scored by blocks of neighbouring chunks.

Queries that hold common words match much of the collection each, so a row for every query and chunk that meet is
out of proportion to what is kept of them. Here the postings of the batch's tokens are written once, in files by ranges
of chunk ids. A task takes a block of chunks and a group of queries and counts in arrays. A first pass returns how many
chunks of a block have how many matches; from these numbers follows which of them each block gives to a query's
candidates, and a second pass returns exactly those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyarrow.parquet import ParquetFile
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.runtime import durable

#: Chunks of a block, about, and query tokens, about, that one task holds.
BLOCK_CHUNKS = 32_768
QUERY_TOKENS = 100_000
#: A token that one in so many chunks of a block holds is kept as a row of zeros and ones.
DENSE = 16


@dataclass(frozen=True)
class Scoring:
    """What scores take from the index and the options; decimals is the rounding, by the column that ranks.

    With top, only rows that can be among a query's first top are returned, with at most per_owner of one owner.
    """

    avgdl: float
    k1: float
    b: float
    decimals: int
    by: str
    top: int | None = None
    per_owner: int = 1


def _files(df: DataFrame, column: str) -> dict[int, list[str]]:
    found: dict[int, list[str]] = {}
    for f in sorted(df.inputFiles()):
        found.setdefault(int(re.search(rf"/{column}=(\d+)/", f)[1]), []).append(f)
    return found


def _read(files: list[str], columns: list[str]) -> pa.Table:
    parts = []
    for f in files:
        system, path = FileSystem.from_uri(f)
        with system.open_input_file(path) as source:
            parts.append(ParquetFile(source).read(columns))
    return pa.concat_tables(parts).combine_chunks()


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


class _Queries:
    """The tokens of a group of queries; ids holds each query's id once."""

    def __init__(self, files: list[str], scored: bool):
        t = _read(files, ["query_id", "token_id", "chosen", *["weight", "bm25_idf"] * scored])
        coded = t.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
        self.ids, query = coded.dictionary, coded.indices.to_numpy()
        order = np.argsort(query, kind="stable")
        self.at = np.searchsorted(query[order], np.arange(len(self.ids) + 1))
        self.token, self.chosen = _numbers(t, "token_id")[order], t.column("chosen").to_numpy()[order].astype(bool)
        if scored:
            self.weight, self.bm25_idf = _numbers(t, "weight")[order], _numbers(t, "bm25_idf")[order]

    def rows(self, n: int) -> slice:
        return slice(self.at[n], self.at[n + 1])


class _Block:
    """The postings of a range of chunks, by token, in the order of chunks within."""

    def __init__(self, files: list[str], facts: list[str], scoring: Scoring | None):
        t = _read(files, ["token_id", "chunk_id", *["tf", "dl"] * (scoring is not None)])
        self.ids, at = np.unique(_numbers(t, "chunk_id"), return_inverse=True)
        token = _numbers(t, "token_id")
        order = np.lexsort((at, token))
        self.at = at[order].astype(np.int32)
        names, start = np.unique(token[order], return_index=True)
        stop = np.append(start[1:], len(order))
        self.rows = {t: slice(a, b) for t, a, b in zip(names.tolist(), start.tolist(), stop.tolist())}
        self.dense = {}
        for name, s in self.rows.items():
            if (s.stop - s.start) * DENSE > len(self.ids):
                self.dense[name] = np.zeros(len(self.ids), np.uint8)
                self.dense[name][self.at[s]] = 1
        self.scoring = scoring
        if scoring is not None:
            tf, dl = _numbers(t, "tf")[order], _numbers(t, "dl")[order]
            self.tf = 1 + np.log(tf)
            self.saturated = (scoring.k1 + 1) * tf / (tf + scoring.k1 * (1 - scoring.b + scoring.b * dl / scoring.avgdl))
            f = _read(facts, ["chunk_id", "norm", "owner"]).sort_by("chunk_id")
            known = _numbers(f, "chunk_id")
            place = np.minimum(np.searchsorted(known, self.ids), len(known) - 1)
            self.known = known[place] == self.ids
            self.norm, self.owner = _numbers(f, "norm")[place], _numbers(f, "owner")[place]

    def matches(self, tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each chunk holds."""
        held = np.zeros(len(self.ids), np.uint8 if len(tokens) < 256 else np.uint32)
        for t in tokens.tolist():
            row = self.dense.get(t)
            if row is not None:
                held += row
            elif (s := self.rows.get(t)) is not None:
                held[self.at[s]] += 1
        return held

    def scores(self, chunks: np.ndarray, tokens: np.ndarray, weights: np.ndarray, bm25_idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cosine and BM25 of chunks, given by their places in order."""
        dot, bm25 = np.zeros(len(chunks)), np.zeros(len(chunks))
        for t, w, i in zip(tokens.tolist(), weights.tolist(), bm25_idf.tolist()):
            if (s := self.rows.get(t)) is None:
                continue
            own = self.at[s]
            place = np.minimum(np.searchsorted(own, chunks), len(own) - 1)
            held = np.flatnonzero(own[place] == chunks)
            dot[held] += w * self.tf[s][place[held]]
            bm25[held] += i * self.saturated[s][place[held]]
        return np.round(dot / self.norm[chunks], self.scoring.decimals), np.round(bm25, self.scoring.decimals)

    def first(self, chunks: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The rows of chunks (places in order) that may be among the first top, each owner with per_owner; ties go to the first."""
        order = np.argsort(-values, kind="stable")
        owner = self.owner[chunks[order]]
        by_owner = np.argsort(owner, kind="stable")
        same = owner[by_owner]
        start = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        nth = np.arange(len(same)) - np.repeat(start, np.diff(np.append(start, len(same))))
        return order[np.sort(by_owner[nth < self.scoring.per_owner])[: self.scoring.top]]


def block_candidates(postings: DataFrame, vectors: DataFrame, chunks: DataFrame, upto: int, after: int = 0, scoring: Scoring | None = None) -> DataFrame:
    """(query_id, chunk_id, matches) of the chunks at the places after + 1 to upto of their query, by matches with chosen tokens, then id.

    postings is (token_id, chunk_id, tf, dl), one row for each token and chunk, vectors (query_id, token_id, chosen), chunks
    (chunk_id), all cheap to read. With scoring, vectors have weight and bm25_idf too, chunks norm and owner, and
    cosine and bm25 come out.
    """
    spark = vectors.sparkSession
    plain = f"query_id {vectors.schema['query_id'].dataType.simpleString()}, chunk_id long, matches int"
    full = plain + ", cosine double, bm25 double" * (scoring is not None)
    # Ranges of ids need not hold the same number of chunks.
    cuts = max(1, -(-chunks.count() // BLOCK_CHUNKS))
    shares = [i / cuts for i in range(1, cuts)]
    bounds = chunks.agg(F.percentile_approx("chunk_id", shares, max(10_000, 20 * cuts))).first()[0] if shares else None
    bucket = Bucketizer(splits=[-float("inf"), *sorted({float(x) for x in bounds or [0]}), float("inf")], inputCol="_id", outputCol="_block")

    def placed(df: DataFrame, label: str) -> dict[int, list[str]]:
        cut = bucket.transform(df.withColumn("_id", F.col("chunk_id").cast("double"))).withColumn("block", F.col("_block").cast("int"))
        return _files(durable(cut.drop("_id", "_block").repartition("block"), label, "block"), "block")

    held = placed(postings.select("token_id", "chunk_id", *["tf", "dl"] * (scoring is not None)), "block-postings")
    known = placed(chunks.select("chunk_id", "norm", "owner"), "block-facts") if scoring is not None else {}
    groups = -(-(vectors.count() or 1) // QUERY_TOKENS)
    grouped = vectors.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))
    asked = _files(durable(grouped.repartition("group"), "query-groups", "group"), "group")
    tasks = [(b, g) for b in sorted(held) for g in sorted(asked)]
    if not tasks:
        return spark.createDataFrame([], full)
    plan = spark.sparkContext.broadcast((tasks, held, known, asked))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks, held, known, asked = plan.value
        for batch in batches:
            for number in batch.column("id").to_pylist():
                b, g = tasks[number]
                block, queries = _Block(held[b], [], None), _Queries(asked[g], False)
                query, matches, n = [], [], []
                for i in range(len(queries.ids)):
                    s = queries.rows(i)
                    count = block.matches(queries.token[s][queries.chosen[s]])
                    for m in range(1, int(count.max()) + 1):
                        if k := np.count_nonzero(count == m):
                            query.append(i)
                            matches.append(m)
                            n.append(k)
                columns = [queries.ids.take(pa.array(query, pa.int32())), pa.array([number] * len(n), pa.int32()), pa.array(matches, pa.int32()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "task", "matches", "n"])

    every = spark.range(0, len(tasks), 1, len(tasks))
    # A query is in one group, so its tasks are in the order of blocks.
    tallied = durable(every.mapInArrow(tally, plain.replace("chunk_id long", "task int") + ", n long"), "block-tallies")
    order = Window.partitionBy("query_id").orderBy(F.col("matches").desc(), "task").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    given = tallied.withColumn("_b", before).select(
        "query_id", "task", "matches", F.greatest(F.lit(0), F.lit(after) - F.col("_b")).alias("lo"), F.least(F.col("n"), F.lit(upto) - F.col("_b")).alias("hi")
    )
    given = _files(durable(given.where("hi > lo").repartition("task"), "block-shares", "task"), "task")
    if not given:
        return spark.createDataFrame([], full)
    work = spark.sparkContext.broadcast((sorted(given), given))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks, held, known, asked = plan.value
        numbers, given = work.value
        for batch in batches:
            for place in batch.column("id").to_pylist():
                number = numbers[place]
                b, g = tasks[number]
                block, queries = _Block(held[b], known.get(b, []), scoring), _Queries(asked[g], scoring is not None)
                share = _read(given[number], ["query_id", "matches", "lo", "hi"])
                of = pc.index_in(share.column("query_id"), value_set=queries.ids).to_numpy()
                cut = np.argsort(of, kind="stable")
                of, m, lo, hi = of[cut], *(_numbers(share, c)[cut] for c in ("matches", "lo", "hi"))
                starts = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))
                parts: list[tuple] = []
                size = 0
                for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
                    i = int(of[a])
                    s = queries.rows(i)
                    count = block.matches(queries.token[s][queries.chosen[s]])
                    rows = np.sort(np.concatenate([np.flatnonzero(count == m[k])[lo[k] : hi[k]] for k in range(a, z)]))
                    if scoring is not None:
                        rows = rows[block.known[rows]]
                        cosine, bm25 = block.scores(rows, queries.token[s], queries.weight[s], queries.bm25_idf[s])
                        if scoring.top is not None and len(rows):
                            best = block.first(rows, cosine if scoring.by == "cosine" else bm25)
                            rows, cosine, bm25 = rows[best], cosine[best], bm25[best]
                        parts.append((np.full(len(rows), i, np.int32), block.ids[rows], count[rows].astype(np.int32), cosine, bm25))
                    else:
                        parts.append((np.full(len(rows), i, np.int32), block.ids[rows], count[rows].astype(np.int32)))
                    size += len(rows)
                    if size >= 100_000:
                        yield _batch(queries, parts)
                        parts, size = [], 0
                if parts:
                    yield _batch(queries, parts)

    return spark.range(0, len(given), 1, len(given)).mapInArrow(collect, full)


def _batch(queries: _Queries, parts: list[tuple]) -> pa.RecordBatch:
    query, *rest = (np.concatenate(c) for c in zip(*parts))
    return pa.RecordBatch.from_arrays([queries.ids.take(pa.array(query)), *map(pa.array, rest)], names=["query_id", "chunk_id", "matches", "cosine", "bm25"][: 1 + len(rest)])
