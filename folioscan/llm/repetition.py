"""Repetition inside single documents: the exact share and a calibrated quality score."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.runtime import durable

_WORD_GAPS = r"[^\p{L}\p{N}]+"
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)

#: Buckets of hashed n-grams.
FEATURES = 1 << 12
#: Rows, at most, on which the classifier is fitted; the bound is a parameter of fit_quality.
TRAIN_ROWS = 4_000
#: Characters of the texts that are worked on at once.
SLICE_CHARS = 1_000_000
#: Characters, at most, of a document that is fitted on, so that what the driver holds is bounded; longer ones are graded all the same.
TRAIN_CHARS = 50_000


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the lower-cased words of all texts, equal for equal words, the offsets of each text in them, and the words by code."""
    clean = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.fill_null(texts, ""), _WORD_GAPS, " "))
    lists = pc.split_pattern(pc.utf8_lower(clean), " ")
    words = lists.flatten()
    codes = words.dictionary_encode()
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
    ids = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(lengths)), lengths)[~empty]
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(np.bincount(doc, minlength=len(lengths)), out=offsets[1:])
    return ids[~empty], offsets, codes.dictionary


def repeated_positions(codes: np.ndarray, offsets: np.ndarray, run: int = 5) -> np.ndarray:
    """Whether each word position lies in a run of words that began earlier in the same text."""
    n = len(codes)
    covered = np.zeros(n + 1, dtype=np.int64)
    if n < run:
        return covered[:n].astype(bool)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(doc[: n - run + 1] == doc[run - 1 :])
    with np.errstate(over="ignore"):
        key = (doc[starts].astype(np.uint64) + np.uint64(1)) * np.uint64(0x2545F4914F6CDD1D)
        for j in range(run):
            key = (key ^ (codes[starts + j].astype(np.uint64) + np.uint64(1))) * np.uint64(_MIX[j % 5])
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(starts), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    hits = starts[again]
    np.add.at(covered, hits, 1)
    np.add.at(covered, hits + run, -1)
    return np.cumsum(covered)[:n] > 0


def _grams(codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams and the text each is in."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(doc[: max(0, len(codes) - n + 1)] == doc[n - 1 :]) if len(codes) >= n else np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        key = np.full(len(starts), n, dtype=np.uint64)
        for j in range(n):
            key = (key ^ codes[starts + j].astype(np.uint64)) * np.uint64(_MIX[j % 5])
            key ^= key >> np.uint64(31)
    return key, doc[starts]


def _chars(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offsets of each text in them."""
    plain = pc.fill_null(texts, "")
    joined = "".join(plain.to_pylist()).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32).astype(np.int64), np.concatenate([[0], np.cumsum(pc.utf8_length(plain).to_numpy(zero_copy_only=False))]).astype(np.int64)


def features(texts: pa.Array, coded: tuple[np.ndarray, np.ndarray, pa.Array] | None = None) -> np.ndarray:
    """Hashed n-grams, a row a text: word 2- and 3-grams and character 12-grams, each in a bucket of its hash.

    A bucket adds up how often its n-grams come again, as a share of the text's n-grams of that length. No feature
    looks at runs of five words, of which the label is made.
    """
    codes, offsets, words = coded or word_codes(texts)
    stable = np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in words.to_pylist()], dtype=np.int64)
    x = np.zeros((len(texts), FEATURES), dtype=np.float32)
    spelled = stable[codes] if len(codes) else codes
    for source, n in (((spelled, offsets), 2), ((spelled, offsets), 3), (_chars(texts), 12)):
        key, doc = _grams(*source, n)
        if not len(key):
            continue
        total = np.bincount(doc, minlength=len(texts))
        with np.errstate(over="ignore"):
            own = np.sort((key & np.uint64((1 << 44) - 1)) | (doc.astype(np.uint64) << np.uint64(44)))
        again = own[1:][own[1:] == own[:-1]]
        row = (again >> np.uint64(44)).astype(np.int64)
        np.add.at(x, (row, ((again ^ (again >> np.uint64(17))) % np.uint64(FEATURES)).astype(np.int64)), (20.0 / total[row]).astype(np.float32))
    return x


class QualityModel:
    """Logistic regression on features, with Platt scaling fitted on rows held out."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def probability(self, texts: pa.Array, coded: tuple[np.ndarray, np.ndarray, pa.Array] | None = None) -> np.ndarray:
        z = features(texts, coded) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))

    @classmethod
    def fit(cls, texts: pa.Array, labels: np.ndarray, seed: int = 11, rounds: int = 250, penalty: float = 1e-4) -> QualityModel:
        """Fit on three quarters of the rows, scale on the others. Without rows, everything is clean."""
        labels = labels.astype(float)
        if not len(labels):
            return cls(np.zeros(FEATURES), 0.0, 1.0, -10.0)
        held = np.random.default_rng(seed).random(len(labels)) < 0.25
        x = np.concatenate([features(texts.slice(at, rows)) for at, rows in _slices(texts)])
        a, y = x[~held], labels[~held]
        # All buckets start as evidence of repetition; those of common words learn that they are none.
        w, b, step = np.full(x.shape[1], 0.1), -1.0, np.zeros(x.shape[1] + 1) + 1e-8
        balance = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) if len(y) else y
        for _ in range(rounds):
            # Products stay in single precision, so that the features are not copied each time.
            p = 1 / (1 + np.exp(-np.clip(a @ w.astype(np.float32) + b, -40, 40)))
            g = (p - y) * balance
            grad = np.append(g.astype(np.float32) @ a + penalty * w, g.sum())
            step += grad**2
            move = 0.1 * grad / np.sqrt(step)
            w, b = w - move[:-1], b - move[-1]
        z, y = (x[held] @ w.astype(np.float32) + b).astype(float), labels[held]
        slope, offset = 1.0, 0.0
        # Newton steps of Platt's two parameters.
        for _ in range(50 if len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40)))
            g = np.array([((p - y) * z).sum() + 1e-3 * (slope - 1), (p - y).sum()])
            v = p * (1 - p)
            h = np.array([[(v * z * z).sum(), (v * z).sum()], [(v * z).sum(), v.sum()]]) + np.eye(2) * 1e-3
            move = np.linalg.solve(h, g)
            slope, offset = slope - float(np.clip(move[0], -1, 1)), offset - float(np.clip(move[1], -1, 1))
        return cls(w.astype(np.float32), float(b), slope, offset)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of at most 256 texts and, but for a longer text on its own, SLICE_CHARS characters."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        room = np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_CHARS, side="right")
        end = max(at + 1, min(at + 256, int(room)))
        yield at, end - at
        at = end


def _shares(texts: pa.Array, run: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    coded = word_codes(texts)
    flags = np.concatenate([[0], np.cumsum(repeated_positions(*coded[:2], run))])
    return np.diff(coded[1]), np.diff(flags[coded[1]]).astype(np.int64), coded


def in_sample(id_col: str, n_docs: int, train_rows: int) -> Column:
    """Whether a document may be one of those the classifier is fitted on."""
    share = min(1.0, 0.9 * train_rows / max(1, n_docs))
    return F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < F.lit(int(1_000_000 * share)))


def fit_quality(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.30, train_rows: int = TRAIN_ROWS, run: int = 5, train_chars: int = TRAIN_CHARS) -> QualityModel:
    """Fit the classifier on at most train_rows documents of at most train_chars characters, chosen and put in order by a hash of the id.

    The tables hold no quality labels, so a document is labelled by its exact
    share. A repeated id counts once, with its least text. Only the fit uses a
    sample; graded() covers all rows.
    """
    part = docs.where(in_sample(id_col, docs.count(), train_rows) & (F.length(text_col) <= train_chars))
    part = part.groupBy(F.col(id_col).alias("id")).agg(F.min(text_col).alias("text"))
    chosen = durable(part.orderBy(F.xxhash64("id"), "id").limit(train_rows), "quality-rows")
    texts = pa.array([r["text"] for r in chosen.orderBy(F.xxhash64("id"), "id").collect()], pa.string())
    words, repeated, _ = _shares(texts, run)
    return QualityModel.fit(texts, repeated >= threshold * np.maximum(words, 1))


def graded(docs: DataFrame, id_col: str, text_col: str, model: QualityModel | None = None, run: int = 5, cuts: tuple[float, float] = (0.2, 0.8)) -> DataFrame:
    """(id, words, repeated, share, probability, band) of every row.

    words are the word positions, repeated those in a run of run words that
    occurred before, share their quotient. probability is the classifier's, band
    clean, doubtful or repetitive by the two fixed cuts; both null without a model.
    A word is a maximal run of letters or digits, lower-cased. A text that is
    null, empty or shorter than a run has share 0. Every row has a result, also
    one with a null or repeated id. Whole texts are scored in Arrow batches; no shuffle.
    """
    schema = f"id {dict(docs.select(F.col(id_col).alias('id')).dtypes)['id']}, words long, repeated long, share double, probability double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _slices(batch.column("text")):
                part = batch.slice(at, rows)
                words, repeated, coded = _shares(part.column("text"), run)
                p = shared.value.probability(part.column("text"), coded) if shared.value else None
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(words), pa.array(repeated), pa.array(repeated / np.maximum(words, 1)), pa.array(p.astype(float)) if p is not None else pa.nulls(len(words), pa.float64())],
                    names=["id", "words", "repeated", "share", "probability"],
                )

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, schema)
    band = F.when(F.col("probability") < cuts[0], "clean").when(F.col("probability") >= cuts[1], "repetitive").when(F.col("probability").isNotNull(), "doubtful")
    return scored.withColumn("band", band)
