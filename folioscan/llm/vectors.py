"""Most similar vectors by additive quantisation: beam-search codes, stored norms, table scoring, exact reranking."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyarrow.parquet import ParquetFile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.runtime import broadcast_if_small, durable

#: Vectors, at most, on which the codebooks are fitted. All vectors are encoded and searched.
FIT_ROWS = 20_000
#: Vectors of a cell on average, and the most that one task scores together. A fuller cell is cut by the first residual
#: codeword, of which a query then tries SUB_PROBES for its first neighbours (whole() leaves none out after), and what is
#: fuller still into blocks, of which it tries all.
CELL_ROWS = 500
BLOCK_ROWS = 4_000
SUB_PROBES = 12
#: Queries that one task scores against a cell; a cell that more queries try is sent to several tasks.
QUERY_ROWS = 50_000
MAX_CELLS = 4_096
#: Vectors of a cell that a query looks at in 8-bit steps after table scoring.
SCREEN = 256
#: Vectors, at most, of a block, whose neighbours one task finds, and the blocks that a smaller table is cut into.
GROUP_ROWS = 20_000
GROUPS = 6
#: Candidates that a task holds before it drops those that later ones have beaten.
POOL_ROWS = 2_000_000


def usable(v: Column, dims: int) -> Column:
    """Whether v has dims finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column as unit float32 vectors."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _to_binary(rows: np.ndarray) -> pa.Array:
    """A binary column with the bytes of each row."""
    flat = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _from_binary(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    """The rows of a binary column without nulls, all of one width."""
    if not len(column):
        return np.empty((0, width), dtype)
    wide = column.type == pa.large_binary()
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype)[at[0] : at[-1]].reshape(-1, width)


class Codebooks:
    """A coarse codebook, whose codeword is also a vector's cell, and residual codebooks, all of full dimension and added up."""

    def __init__(self, coarse: np.ndarray, books: np.ndarray, beam: int = 4):
        self.coarse, self.books, self.beam = coarse, books, beam

    @staticmethod
    def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
        centers = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
        for _ in range(rounds):
            near = np.argmax(x @ centers.T - 0.5 * (centers**2).sum(1), axis=1)
            count = np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            starts = np.concatenate([[0], np.cumsum(count)[:-1]])
            sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]), x.dtype)]), np.minimum(starts, len(x)), axis=0)
            full = count > 0
            centers[full] = sums[full] / count[full, None]
            centers[~full] = x[rng.choice(len(x), int((~full).sum()))]
        return centers

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, books: int = 6, size: int = 64, seed: int = 5, rounds: int = 1) -> Codebooks:
        """Fit on unit vectors x: k-means on successive residuals, then all codebooks together by least squares on the codes."""
        rng = np.random.default_rng(seed)
        cells = max(1, min(cells, len(x)))
        coarse = cls._kmeans(x, cells, rng)
        residual = x - coarse[np.argmax(x @ coarse.T - 0.5 * (coarse**2).sum(1), axis=1)]
        learned = []
        for _ in range(books):
            book = cls._kmeans(residual, size, rng, 6)
            residual = residual - book[np.argmax(residual @ book.T - 0.5 * (book**2).sum(1), axis=1)]
            learned.append(book)
        made = cls(coarse, np.stack(learned))
        for _ in range(rounds):
            codes = made.encode(x)
            target = x - made.coarse[codes[:, 0]]
            wide = np.zeros((books * size, books * size))
            right = np.zeros((books * size, x.shape[1]))
            flat = codes[:, 1:].astype(np.int64) + np.arange(books) * size
            for i in range(books):
                np.add.at(right, flat[:, i], target)
                for j in range(books):
                    wide += np.bincount(flat[:, i] * books * size + flat[:, j], minlength=wide.size).reshape(wide.shape)
            made = cls(coarse, np.linalg.solve(wide + np.eye(len(wide)) * 1.0, right).astype(np.float32).reshape(books, size, -1))
        return made

    def encode(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Codes by beam search: column 0 the cell, then one codeword of each residual codebook."""
        return np.concatenate([self._encode(x[i : i + block]) for i in range(0, len(x), block)]) if len(x) else np.empty((0, 1 + len(self.books)), np.int32)

    def _encode(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        near = np.argmax(x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1), axis=1)
        # Beams: the residual left, its squared length, and the codes chosen. The cell is the nearest one.
        left = (x - self.coarse[near])[:, None, :]
        codes = near.astype(np.int32)[:, None, None]
        rows = np.arange(n)[:, None]
        for book in self.books:
            cost = (left**2).sum(2)[:, :, None] - 2 * (left @ book.T) + (book**2).sum(1)
            flat = cost.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            pick = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            src, word = pick // len(book), pick % len(book)
            left = left[rows, src] - book[word]
            codes = np.concatenate([codes[rows, src], word[:, :, None].astype(np.int32)], axis=2)
        best = np.argmin((left**2).sum(2), axis=1)
        return codes[np.arange(n), best]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = self.coarse[codes[:, 0]].copy()
        for m, book in enumerate(self.books):
            out += book[codes[:, m + 1]]
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        score = x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1)
        count = min(count, score.shape[1])
        return np.argpartition(-score, count - 1, axis=1)[:, :count]

    def word_probes(self, left: np.ndarray, count: int) -> np.ndarray:
        """The nearest codewords of the first residual codebook to residuals."""
        book = self.books[0]
        score = left @ book.T - 0.5 * (book**2).sum(1)
        count = min(count, len(book))
        return np.argpartition(-score, count - 1, axis=1)[:, :count]

    def table_scores(self, queries: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Dot products of queries with the encoded vectors of one cell, by tables of each query with each codeword."""
        total = np.repeat((queries @ self.coarse[cell])[:, None], len(codes), axis=1)
        for m, book in enumerate(self.books):
            total += (queries @ book.T)[:, codes[:, m]]
        return total


class VectorIndex:
    """An index over every usable vector of a table (id, v).

    A vector counts if it has dims finite numbers, not all zero; others, and
    null ids, take no part. A repeated id counts once, with the vector of
    least hash if they differ. Vectors that point in exactly the same direction as stored (equal arrays) are
    searched once, by their least id, and their ids are put back at the end.
    """

    def __init__(self, rows: DataFrame, id_col: str, vector_col: str, dims: int = 64, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS):
        spark = rows.sparkSession
        self.dims = dims
        good = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col), dims))
        self.source = good.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
        self.source = self.source.withColumn("h", F.xxhash64("v"))
        ids = self.source.groupBy("id").agg(F.min("h").alias("h"))
        self.ids = durable(ids, "vector-ids")
        self.reps = durable(self.ids.groupBy("h").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vector-reps")
        n = self.reps.count()
        self.cells = max(1, min(MAX_CELLS, n // cell_rows))
        share = min(1.0, 0.95 * fit_rows / max(1, n))
        sample = self.source.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).dropDuplicates(["h"])
        drawn = sample.orderBy("h").limit(fit_rows).select("v").toPandas()["v"]
        x = np.stack(drawn.to_list()).astype(np.float32) if len(drawn) else np.ones((1, dims), np.float32)
        x = _matrix(pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dims), dims)
        self.books = Codebooks.fit(x, self.cells)
        self.shared = spark.sparkContext.broadcast(self.books)
        self._encoded: DataFrame | None = None

    def encoded(self) -> DataFrame:
        """(id, h, cell, word, codes, norm, own, q, s): codes as bytes, word the first of them, the length of the decoded vector, its dot product with the vector, and the vector in 8-bit and 16-bit steps."""
        if self._encoded is None:
            shared, dims = self.shared, self.dims

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x = _matrix(batch.column("v"), dims)
                    codes = shared.value.encode(x)
                    near = shared.value.decode(codes)
                    scaled = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-12)
                    steps, fine = np.rint(scaled * 127).astype(np.int8), np.rint(scaled * 32767).astype(np.int16)
                    own = (near * x).sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("id"),
                            batch.column("h"),
                            pa.array(codes[:, 0].astype(np.int32)),
                            pa.array(codes[:, 1].astype(np.int32)),
                            _to_binary(codes[:, 1:].astype(np.uint8)),
                            pa.array(np.linalg.norm(near, axis=1).astype(np.float32)),
                            pa.array(own.astype(np.float32)),
                            _to_binary(steps),
                            _to_binary(fine.view(np.int8)),
                        ],
                        names=["id", "h", "cell", "word", "codes", "norm", "own", "q", "s"],
                    )

            schema = "id long, h long, cell int, word int, codes binary, norm float, own float, q binary, s binary"
            coded = self.source.mapInArrow(run, schema)
            # An id has one h here, so by both columns repeats drop out where the join has put them.
            self._encoded = durable(coded.join(self.reps.select("id", "h"), ["id", "h"], "left_semi").dropDuplicates(["id", "h"]), "codes")
        return self._encoded

    def candidates(self, queries: DataFrame | None, probes: int, per_cell: int, screen: int = SCREEN) -> DataFrame:
        """(a, b, score): for query ids (all if None), vectors of the probed cells by estimated cosine.

        Of the screen best of every cell and block by table score, the per_cell best by 8-bit steps.
        """
        coded = self.encoded()
        asked = coded if queries is None else coded.join(queries.select("id").distinct(), "id", "left_semi")
        shared, dims, books, cells, size = self.shared, self.dims, len(self.books.books), self.cells, self.books.books.shape[1]
        # Sizes by cell, and by codeword within full cells: at most MAX_CELLS times the codebook's size numbers.
        rows = F.count(F.lit(1)).alias("n")
        full = {r["cell"] for r in coded.groupBy("cell").agg(rows).where(F.col("n") > BLOCK_ROWS).collect()}
        words = coded.where(F.col("cell").isin(sorted(full))).groupBy("cell", "word").agg(rows).collect() if full else []
        layout = [(r["cell"], r["word"], -(-r["n"] // BLOCK_ROWS)) for r in words]
        # Blocks by cell and codeword; the last column, which -1 means, is the whole cell.
        blocks = np.zeros((cells + 1, size + 1), np.int64)
        blocks[:, -1] = 1
        for c, w, n in layout:
            blocks[c, w] = n
        plan = coded.sparkSession.sparkContext.broadcast((np.array([c in full for c in range(cells + 1)]), blocks))

        def places(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Query row, cell and codeword (-1 for a whole cell) of everything the queries try."""
            is_full = plan.value[0]
            cell = shared.value.probes(steps, probes)
            row, cell = np.repeat(np.arange(len(steps)), cell.shape[1]), cell.ravel()
            deep = is_full[cell]
            word = np.full(len(row), -1)
            if not deep.any():
                return row, cell, word
            inner = shared.value.word_probes(steps[row[deep]] - shared.value.coarse[cell[deep]], SUB_PROBES)
            wide = inner.shape[1]
            return (
                np.concatenate([row[~deep], np.repeat(row[deep], wide)]),
                np.concatenate([cell[~deep], np.repeat(cell[deep], wide)]),
                np.concatenate([word[~deep], inner.ravel()]),
            )

        def unit_steps(batch: pa.RecordBatch) -> np.ndarray:
            steps = _from_binary(batch.column("q"), dims, np.int8).astype(np.float32)
            return steps / np.linalg.norm(steps, axis=1, keepdims=True)

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((cells + 1, size + 1), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    _, cell, word = places(unit_steps(batch))
                    np.add.at(total, (cell, word), 1)
            cell, word = np.nonzero(total)
            cols = [pa.array(x.astype(np.int32)) for x in (cell, np.where(word == size, -1, word))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total[cell, word])], names=["cell", "word", "n"])

        tries = asked.select("q").mapInArrow(tally, "cell int, word int, n long").groupBy("cell", "word").agg(F.sum("n").alias("n"))
        splits = {(r["cell"], r["word"]): -(-r["n"] // QUERY_ROWS) for r in tries.where(F.col("n") > QUERY_ROWS).collect()}
        turns_of = np.ones((cells + 1, size + 1), np.int64)
        for key, n in splits.items():
            turns_of[key] = n
        split = coded.sparkSession.sparkContext.broadcast(turns_of)

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            many = plan.value[1]
            for batch in batches:
                if not batch.num_rows:
                    continue
                row, cell, word = places(unit_steps(batch))
                count, turn = many[cell, word], row % split.value[cell, word]
                part = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                cols = [pa.array(np.repeat(x, count).astype(np.int32)) for x in (cell, word)]
                take = pa.array(np.repeat(row, count))
                cols += [pa.array(part.astype(np.int32)), pa.array(np.repeat(turn, count).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*cols, batch.column("id").take(take), batch.column("q").take(take)], names=["cell", "word", "part", "turn", "id", "q"])

        base = coded.withColumn("part", F.lit(0))
        if layout:
            cuts = coded.sparkSession.createDataFrame(layout, "cell int, word int, blocks int")
            base = coded.join(F.broadcast(cuts), ["cell", "word"], "left")
            base = base.withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.lit(0)))
            base = base.withColumn("word", F.when(F.col("blocks").isNull(), -1).otherwise(F.col("word")))
        else:
            base = base.withColumn("word", F.lit(-1))
        if splits:
            turns = coded.sparkSession.createDataFrame([(c, w, n) for (c, w), n in splits.items()], "cell int, word int, turns int")
            base = base.join(F.broadcast(turns), ["cell", "word"], "left")
            base = base.withColumn("turn", F.explode(F.sequence(F.lit(0), F.coalesce("turns", F.lit(1)) - 1)))
        else:
            base = base.withColumn("turn", F.lit(0))
        base = base.select("cell", "word", "part", "turn", "id", "codes", "norm", "own", "q")
        empty = F.lit(None)
        probe = asked.select("id", "q").mapInArrow(reach, "cell int, word int, part int, turn int, id long, q binary").select(
            "cell", "word", "part", "turn", "id", empty.cast("binary").alias("codes"), empty.cast("float").alias("norm"), empty.cast("float").alias("own"), "q"
        )

        def score(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = key[0].as_py()
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            for batch in batches:
                stored = batch.column("codes").is_valid()
                b, q = batch.filter(stored), batch.filter(pc.invert(stored))
                columns = (
                    b.column("id").to_numpy(),
                    _from_binary(b.column("codes"), books, np.uint8),
                    b.column("norm").to_numpy(zero_copy_only=False),
                    b.column("own").to_numpy(zero_copy_only=False),
                    _from_binary(b.column("q"), dims, np.int8),
                    q.column("id").to_numpy(),
                    _from_binary(q.column("q"), dims, np.int8),
                )
                for part, column in zip(parts, columns):
                    part.append(column)
            ids, codes, norm, own, kept, asks, steps = (np.concatenate(p) for p in parts)
            kept = kept.astype(np.float32)
            kept /= np.maximum(np.linalg.norm(kept, axis=1, keepdims=True), 1e-6)
            for at in range(0, len(asks) if len(ids) else 0, 1024):
                x = steps[at : at + 1024].astype(np.float32)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                dots = shared.value.table_scores(x, cell, codes)
                # A codeword sum is about the mean of its vectors, so dot is the best guess of the cosine; the best by it are looked at in 8-bit steps.
                wide = min(screen, dots.shape[1])
                j = np.argpartition(-dots, wide - 1, axis=1)[:, :wide]
                fine = np.stack([kept[row] @ q for row, q in zip(j, x)])
                k = min(per_cell, wide)
                best = np.argpartition(-fine, k - 1, axis=1)[:, :k]
                value, j = np.take_along_axis(fine, best, 1).ravel(), np.take_along_axis(j, best, 1).ravel()
                i = np.repeat(np.arange(len(x)), k)
                a, b = asks[at + i], ids[j]
                keep = a != b
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[keep]), pa.array(b[keep]), pa.array(value[keep].astype(np.float32))], names=["a", "b", "score"]
                )

        return base.unionByName(probe).groupBy("cell", "word", "part", "turn").applyInArrow(score, "a long, b long, score float")

    def _blocks(self, rows: DataFrame, label: str) -> list[tuple[list[int], list[str]]]:
        """Write rows (cell, id, ...) once, in files by block; the cells and files of every block.

        A block holds cells that lie together along the widest direction of their centres, GROUP_ROWS vectors at most; a
        fuller cell has blocks of its own.
        """
        sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        most = max(1, min(GROUP_ROWS, -(-sum(sizes.values()) // GROUPS)))
        spread = self.books.coarse - self.books.coarse.mean(0)
        along = spread @ np.linalg.svd(spread, full_matrices=False)[2][0]
        layout, block, held = [], 0, 0
        for c in np.argsort(along, kind="stable").tolist():
            n = sizes.get(c, 0)
            if not n:
                continue
            if held and held + n > most:
                block, held = block + 1, 0
            own = -(-n // most)
            layout.append((c, block, own))
            block, held = (block + own, 0) if own > 1 else (block, held + n)
        if not layout:
            return []
        plan = F.broadcast(rows.sparkSession.createDataFrame(layout, "cell int, first int, own int"))
        placed = rows.join(plan, "cell").withColumn("block", (F.col("first") + F.pmod("id", "own")).cast("int")).drop("first", "own")
        files: dict[int, list[str]] = {}
        for f in durable(placed.repartition("block"), label, "block").inputFiles():
            files.setdefault(int(re.search(r"/block=(\d+)/", f)[1]), []).append(f)
        cells = {b: [c for c, first, own in layout if first <= b < first + own] for b in files}
        return [(cells[b], sorted(files[b])) for b in sorted(files)]

    def whole(self, k: int, least: float, floors: DataFrame | None = None) -> DataFrame:
        """(a, b): every pair in which b can be among the k best of a, with a cosine of least at least; no cell is left out unless a bound shows it may be.

        For all ids or, with floors (id, floor), for those ids only, each with its own cosine in place of least.
        Two vectors are at least as far apart as along the line between the centres of their cells, so vectors of two cells are
        passed over only if they are farther apart on it than the cosine asked for allows. What is left is
        compared by dot products of 16-bit steps, whose error is bounded. The vectors are written once, in blocks; a task
        keeps the best of one block's vectors while it reads the other blocks, so neither copies nor
        candidates of more than one task are shuffled, and disk grows with the rows alone.
        """
        coded, shared, dims, cells = self.encoded(), self.shared, self.dims, self.cells
        spark = coded.sparkSession
        # Rounding to 16-bit steps turns a unit vector by at most sqrt(dims) / 65,534; both may be turned, and a dot product is rounded.
        error = 2 * dims**0.5 / 65_534 + 1e-5
        stored = self._blocks(coded.select("cell", "id", "s"), "blocks")
        if floors is None:
            asked = stored
        else:
            asked = self._blocks(coded.join(floors.select("id", F.col("floor").cast("double").alias("floor")), "id").select("cell", "id", "s", "floor"), "asked-blocks")
        if not asked:
            return spark.createDataFrame([], "a long, b long")
        plan, all_ids = spark.sparkContext.broadcast((asked, stored)), floors is None

        def limit(cosine: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(2 - 2 * cosine, 0)) + 2e-3

        class Side:
            """The vectors of a block in the order of their cells, and where each cell begins."""

            def __init__(self, files: list[str], with_floor: bool = False):
                parts = []
                for f in files:
                    system, path = FileSystem.from_uri(f)
                    with system.open_input_file(path) as source:
                        parts.append(ParquetFile(source).read(["id", "cell", "s", *["floor"] * with_floor]))
                held = pa.concat_tables(parts).combine_chunks()
                cell = held.column("cell").to_numpy()
                order = np.argsort(cell, kind="stable")
                x = _from_binary(held.column("s").chunk(0), 2 * dims, np.int8).view(np.int16).reshape(-1, dims)[order].astype(np.float32)
                self.x = x / np.linalg.norm(x, axis=1, keepdims=True)
                self.ids, self.cell = held.column("id").to_numpy()[order], cell[order]
                self.names, start = np.unique(self.cell, return_index=True)
                self.at = np.append(start, len(order))
                self.own = (self.x * shared.value.coarse[self.cell]).sum(1)
                self.floor = held.column("floor").to_numpy()[order] if with_floor else np.full(len(order), least)

            def planes(self, to: np.ndarray, rows: slice = slice(None)) -> np.ndarray:
                """Distance of every row from the planes halfway between the centre of its cell and those of others, below 0 beyond them; 0 if the centres are as good as one."""
                c, cell = shared.value.coarse, self.cell[rows]
                half = (c**2).sum(1) / 2
                gap = np.sqrt(np.maximum(2 * (half[self.names][:, None] + half[to] - c[self.names] @ c[to].T), 0))[np.searchsorted(self.names, cell)]
                far = half[to] - half[cell][:, None] - self.x[rows] @ c[to].T + self.own[rows][:, None]
                return np.where(gap > 1e-2, far / np.maximum(gap, 1e-2), 0)

        class Pool:
            """The best of every row so far; floor rises to what a row's k-th best allows."""

            def __init__(self, floor: np.ndarray):
                self.floor, self.parts, self.held = floor, [], 0

            def add(self, rows: np.ndarray, scores: np.ndarray, others: np.ndarray) -> None:
                if scores.shape[1] > k:
                    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k] - np.float32(2 * error)
                    self.floor[rows] = np.maximum(self.floor[rows], kth)
                i, j = np.nonzero(scores >= self.floor[rows][:, None])
                self.parts.append((rows[i], others[j], scores[i, j]))
                self.held += len(i)
                if self.held > POOL_ROWS:
                    self.shrink()

            def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                if not self.parts:
                    return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
                row, other, value = (np.concatenate(p) for p in zip(*self.parts))
                order = np.lexsort((-value, row))
                row, other, value = row[order], other[order], value[order]
                start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
                full = start[np.diff(np.append(start, len(row))) >= k]
                self.floor[row[full]] = np.maximum(self.floor[row[full]], value[full + k - 1] - np.float32(2 * error))
                keep = value >= self.floor[row]
                self.parts = [(row[keep], other[keep], value[keep])]
                self.held = int(keep.sum())
                return self.parts[0]

        def meet(xs: Side, ys: Side, pool: Pool) -> None:
            """Compare the rows of two blocks, cell by cell."""
            # How far beyond the plane a row's neighbours may lie, and how far the others do.
            room = limit(pool.floor)[:, None] - xs.planes(ys.names)
            away = ys.planes(xs.names)
            some = np.maximum.reduceat(room, xs.at[:-1], axis=0) >= np.minimum.reduceat(away, ys.at[:-1], axis=0).T
            for i, j in np.argwhere(some):
                rows, cols = np.arange(xs.at[i], xs.at[i + 1]), np.arange(ys.at[j], ys.at[j + 1])
                free, off = room[rows, j], away[cols, i]
                rows, cols = rows[free >= off.min()], cols[off <= free.max()]
                rows, cols = rows[np.argsort(-room[rows, j], kind="stable")], cols[np.argsort(away[cols, i], kind="stable")]
                free, off, y = room[rows, j], away[cols, i], ys.x[cols]
                strip = max(128, min(2048, len(rows) // 8))
                for lo in range(0, len(rows), strip):
                    row = rows[lo : lo + strip]
                    x, end = xs.x[row], int(np.searchsorted(off, free[lo], "right"))
                    for part in range(0, end, 4096):
                        upto = min(part + 4096, end)
                        dots = x @ y[part:upto].T
                        if xs.names[i] == ys.names[j]:
                            dots[xs.ids[row][:, None] == ys.ids[cols[part:upto]]] = -2
                        high = dots.max(1) >= pool.floor[row]
                        if high.any():
                            pool.add(row[high], dots[high], ys.ids[cols[part:upto]])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asks, others = plan.value
            for batch in batches:
                for number in batch.column("id").to_pylist():
                    xs = Side(asks[number][1], not all_ids)
                    pool = Pool(xs.floor.astype(np.float32) - np.float32(error))
                    # No vector lies beyond the planes around its own cell by more than rounding.
                    reach = np.zeros(cells, bool)
                    for lo in range(0, len(xs.x), 2048):
                        rows = slice(lo, lo + 2048)
                        reach |= (xs.planes(np.arange(cells), rows) <= limit(pool.floor[rows])[:, None] + 1e-3).any(0)
                    # The nearest blocks first, so that floors rise early.
                    for b in sorted(range(len(others)), key=lambda b: abs(b - number)):
                        if reach[others[b][0]].any():
                            meet(xs, xs if all_ids and b == number else Side(others[b][1]), pool)
                    row, to, value = pool.shrink()
                    yield pa.RecordBatch.from_arrays([pa.array(xs.ids[row]), pa.array(to)], names=["a", "b"])

        return spark.range(0, len(asked), 1, len(asked)).mapInArrow(compare, "a long, b long")

    def exact(self, pairs: DataFrame) -> DataFrame:
        """(a, b, cosine) of pairs (a, b) of searched ids, from the stored vectors."""
        dims = self.dims
        # Only vectors in a pair are read on; if their ids are few they go to the vectors, else both are shuffled.
        named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(self.reps.select("id", "h"), "id")
        named = broadcast_if_small(durable(named, "pair-ids"))
        picked = durable(self.source.join(named, ["id", "h"], "left_semi").dropDuplicates(["id"]).select("id", "v"), "pair-vectors")
        left = picked.select(F.col("id").alias("a"), F.col("v").alias("va"))
        right = picked.select(F.col("id").alias("b"), F.col("v").alias("vb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    va = batch.column("va").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                    vb = batch.column("vb").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                    va /= np.linalg.norm(va, axis=1, keepdims=True)
                    vb /= np.linalg.norm(vb, axis=1, keepdims=True)
                    yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((va * vb).sum(1))], names=["a", "b", "cosine"])

        return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, cosine double")

    def _expand(self, near: DataFrame, k: int, asked: DataFrame | None) -> DataFrame:
        """Neighbours between searched ids put back to all ids: (id, other, cosine), the k best of each id, ties by id."""
        group = Window.partitionBy("h").orderBy("id")
        # Of equal vectors only the first k + 1 can be among the k best, ties going to the smaller id.
        first = self.ids.withColumn("r", F.row_number().over(group)).where(F.col("r") <= k + 1)
        named = self.reps.select(F.col("id").alias("rep"), "h", "copies")
        front = first.join(named, "h").select("rep", F.col("id").alias("other"))
        own = self.ids if asked is None else self.ids.join(asked.select("id").distinct(), "id", "left_semi")
        own = own.join(named, "h").select("id", "rep", "copies")
        far = near.select(F.col("a").alias("rep"), F.col("b").alias("to"), "cosine")
        apart = own.join(far, "rep").join(front.withColumnRenamed("rep", "to"), "to").select("id", "other", "cosine")
        same = own.where("copies > 1").join(front, "rep").where("id <> other").select("id", "other", F.lit(1.0).alias("cosine"))
        best = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
        return apart.unionByName(same).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def nearest(self, k: int = 10, queries: DataFrame | None = None, probes: int | None = None, per_cell: int = 24, rerank: int = 40) -> DataFrame:
        """(id, other, cosine, rank): the k most similar vectors of every query id, or of all, after exact reranking.

        The codes of 0.9 times the root of the number of cells, 16 at least unless told otherwise, give k good
        neighbours; then every cell that can hold a better one than the k-th of them is searched.
        """
        probes = probes or max(16, round(0.9 * self.cells**0.5))
        reps = self.reps.select("id")
        if queries is not None:
            asked_h = self.ids.join(queries.select("id").distinct(), "id", "left_semi").select("h").distinct()
            reps = durable(self.reps.join(asked_h, "h", "left_semi").select("id"), "asked")
        found = self.candidates(None if queries is None else reps, probes, per_cell)
        top = Window.partitionBy("a").orderBy(F.col("score").desc(), "b")
        short = durable(found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= rerank).select("a", "b"), "candidates")
        best = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
        kth = self.exact(short).withColumn("r", F.row_number().over(best)).where(F.col("r") == k)
        floors = reps.join(kth.select(F.col("a").alias("id"), "cosine"), "id", "left").select("id", F.coalesce("cosine", F.lit(-1.0)).alias("floor"))
        pairs = durable(self.whole(k, -1.0, durable(floors, "floors")), "whole")
        near = self.exact(pairs).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
        return self._expand(durable(near, "neighbours"), k, queries)

    def close(self, least: float, k: int = 10) -> DataFrame:
        """(id, other, cosine, rank): of the k most similar vectors of every id those with a cosine of at least least; none is left out."""
        pairs = durable(self.whole(k, least), "candidates")
        exact = durable(self.exact(pairs).where(F.col("cosine") >= least), "close-pairs")
        best = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
        near = exact.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
        return self._expand(near, k, None)


def compared_with_all(index: VectorIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """(id, other, cosine, rank): the k most similar vectors of a bounded number of query ids, by comparing each with every vector; for measuring recall.

    Each task compares the queries with its vectors and gives its k best; what
    moves is k rows a query and task. Copies are put back as in the index.
    """
    dims = index.dims
    asked = index.ids.join(queries.select("id").distinct(), "id", "left_semi").join(index.reps.select(F.col("id").alias("rep"), "h"), "h")
    vectors = index.source.join(index.reps.select("id", "h"), ["id", "h"], "left_semi").dropDuplicates(["id"]).select("id", "v")
    vectors = durable(vectors, "all-vectors")
    rows = vectors.join(asked.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").orderBy("id").collect()
    ids = np.array([r["id"] for r in rows], dtype=np.int64)
    x = np.array([r["v"] for r in rows], dtype=np.float64).reshape(-1, dims)
    shared = queries.sparkSession.sparkContext.broadcast((ids, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for batch in batches:
            if not batch.num_rows or not len(own):
                continue
            y = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            to = batch.column("id").to_numpy()
            score = q @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
            score[own[:, None] == to] = -3
            wide = min(k + 1, score.shape[1])
            at = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
            cols = np.repeat(own, wide), to[at].ravel(), np.take_along_axis(score, at, 1).ravel()
            keep = cols[2] > -2
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["a", "b", "cosine"])

    found = vectors.mapInArrow(best, "a long, b long, cosine double")
    top = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    near = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).drop("r")
    return index._expand(durable(near, "compared"), k, queries)
