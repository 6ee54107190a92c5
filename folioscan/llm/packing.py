"""Filling fixed-capacity containers from the histogram of item lengths."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.sizes import salted_rank, token_count
from folioscan.runtime import durable


def combinations_filling(lengths: np.ndarray, capacity: int, window: int) -> np.ndarray:
    """Rows (a, b, c), a <= b <= c, 0 for none, of one to three lengths that fill capacity to within window."""
    present = np.zeros(capacity + 1, dtype=bool)
    present[lengths] = True
    out = [np.array([(0, 0, x) for x in lengths if x >= capacity - window], dtype=np.int64).reshape(-1, 3)]
    for gap in range(window + 1):
        b = capacity - gap - lengths
        ok = (b >= lengths) & (b <= capacity)
        ok[ok] &= present[b[ok]]
        out.append(np.stack([np.zeros(ok.sum(), np.int64), lengths[ok], b[ok]], axis=1))
    # Of the triples those that fill exactly, with the middle length on a grid of at most 96 values.
    grid = np.unique(lengths[np.linspace(0, len(lengths) - 1, min(len(lengths), 96)).astype(int)])
    a, b = np.meshgrid(lengths, grid, indexing="ij")
    c = capacity - a - b
    ok = (a <= b) & (c >= b) & (c <= capacity)
    ok[ok] &= present[c[ok]]
    out.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
    return np.concatenate(out)


def solve_counts(combos: np.ndarray, wanted: np.ndarray, rounds: int = 150) -> np.ndarray:
    """Non-negative repeat counts x least-squares fitting A x = wanted, A[l, j] the times combo j uses length l.

    Multiplicative updates keep x non-negative; A has three entries a column
    and is applied by gather and bincount.
    """
    size = len(wanted)
    weight = (combos > 0).astype(float)

    def times(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(combos[:, i], weights=weight[:, i] * x, minlength=size) for i in range(3))

    def transposed(y: np.ndarray) -> np.ndarray:
        return sum(weight[:, i] * y[combos[:, i]] for i in range(3))

    goal = transposed(wanted)
    uses = times(np.ones(len(combos)))
    x = goal / np.maximum(transposed(uses), 1e-9)
    for _ in range(rounds):
        x *= goal / np.maximum(transposed(times(x)), 1e-9)
    return x


def plan_containers(hist: dict[int, int], capacity: int, window: int = 8) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Patterns (repeats, ((length, times), ...)) that use up hist exactly, each within capacity.

    Shallow combinations get repeat counts by non-negative least squares,
    rounded down; what is left is packed greedily, the largest length that still
    fits first, a whole pattern at a time. Work and result depend on the number
    of distinct lengths, at most capacity, not on the number of items.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, count in hist.items():
        left[length] = count
    left[0] = 0
    patterns: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    lengths = np.flatnonzero(left)
    if not len(lengths):
        return patterns
    combos = combinations_filling(lengths, capacity, window)
    if len(combos):
        x = solve_counts(combos, left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 1:
                break
            kinds, times = np.unique(combos[j][combos[j] > 0], return_counts=True)
            reps = int(min(np.floor(x[j]), (left[kinds] // times).min()))
            if reps > 0:
                left[kinds] -= reps * times
                patterns.append((reps, tuple(zip(kinds.tolist(), times.tolist()))))
    rest = {int(k): int(left[k]) for k in np.flatnonzero(left)}
    order = sorted(rest)
    while order:
        space, pattern, at = capacity, [], len(order)
        while at > 0:
            at = bisect_right(order, space, 0, at)
            if at == 0:
                break
            length = order[at - 1]
            times = min(rest[length], space // length)
            pattern.append((length, times))
            space -= length * times
            at -= 1
        reps = min(rest[length] // times for length, times in pattern)
        patterns.append((reps, tuple(pattern)))
        for length, times in pattern:
            rest[length] -= reps * times
            if not rest[length]:
                del rest[length]
                order.remove(length)
    return patterns


def pack(docs: DataFrame, id_col: str, text_col: str, capacity: int = 2048) -> DataFrame:
    """Every piece of every document in its container: (id, n_tokens, piece_no, n_pieces, start_token, length, container_id).

    Only a document larger than capacity is split, into full pieces and a rest.
    A null or empty text, or one of white space, has no tokens and takes no
    place: one row with length 0 and null container. Null ids have no row;
    a repeated id is packed each time it comes. Texts are only counted; ids and
    counts are all that moves. Items of one length are ranked in salted parts
    and go to containers by rank, from a plan whose size is bounded by capacity.
    """
    sizes = durable(
        docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), token_count(F.col(text_col)).alias("n_tokens")),
        "sizes",
    )
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    items = (
        sizes.withColumn("n_pieces", pieces)
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("start_token", F.col("piece_no").cast("long") * capacity)
        .withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("start_token")))
    )
    hist = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = plan_containers({k: v for k, v in hist.items() if k > 0}, capacity)
    ranked = salted_rank(items, ["length"], ["id", "piece_no"], sum(hist.values()))

    key, first, times, base = [], [], [], []
    taken: dict[int, int] = {}
    container = 0
    for reps, pattern in patterns:
        for length, many in pattern:
            at = taken.get(length, 0)
            key.append((length, at))
            first.append(at)
            times.append(many)
            base.append(container)
            taken[length] = at + reps * many
        container += reps
    order = sorted(range(len(key)), key=key.__getitem__)
    slot_len = np.array([key[i][0] for i in order], dtype=np.int64)
    slot_first = np.array([first[i] for i in order], dtype=np.int64)
    slot_times = np.array([times[i] for i in order], dtype=np.int64)
    slot_base = np.array([base[i] for i in order], dtype=np.int64)
    from_len = np.searchsorted(slot_len, np.arange(capacity + 2))
    shared = docs.sparkSession.sparkContext.broadcast((slot_first, slot_times, slot_base, from_len))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, many, bases, starts = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            out = np.full(len(length), -1, dtype=np.int64)
            by_length = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[by_length])) + 1
            for rows in np.split(by_length, cuts) if len(length) else []:
                size = int(length[rows[0]])
                if size > 0:
                    lo, hi = starts[size], starts[size + 1]
                    slot = lo + np.searchsorted(firsts[lo:hi], rank[rows], side="right") - 1
                    out[rows] = bases[slot] + (rank[rows] - firsts[slot]) // many[slot]
            cols = [batch.column(c) for c in ("id", "n_tokens", "piece_no", "n_pieces", "start_token", "length")]
            cols.append(pa.array(out, mask=out < 0))
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_tokens", "piece_no", "n_pieces", "start_token", "length", "container_id"])

    schema = f"id {dict(items.dtypes)['id']}, n_tokens long, piece_no int, n_pieces int, start_token long, length long, container_id long"
    return ranked.select("id", "n_tokens", "piece_no", "n_pieces", "start_token", "length", "rank").mapInArrow(assign, schema)
