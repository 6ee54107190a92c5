"""Cutting oversized texts into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line break, or white space right after a sentence mark or a double backslash.
BOUNDARY = re.compile(r"[\n\r]|(?<=[.!?;])\s|(?<=\\\\)\s")
TOKEN = re.compile(r"[^\W]+|[^\w\s]")


class _Chars:
    """Size in characters: the offsets are their own prefix sums."""

    def __init__(self, text: str):
        self.n = len(text)

    def size(self, s: int, e: int) -> int:
        return e - s

    def reach(self, s: int, limit: int) -> int:
        return min(self.n, s + limit)

    def back(self, e: int, overlap: int) -> int:
        return max(0, e - overlap)


class _Tokens:
    """Size in tokens: starts[i] is the offset of token i, so counts are differences of binary searches."""

    def __init__(self, text: str):
        self.n = len(text)
        self.starts = [m.start() for m in TOKEN.finditer(text)]

    def size(self, s: int, e: int) -> int:
        return bisect_left(self.starts, e) - bisect_left(self.starts, s)

    def reach(self, s: int, limit: int) -> int:
        i = bisect_left(self.starts, s) + limit
        return self.starts[i] if i < len(self.starts) else self.n

    def back(self, e: int, overlap: int) -> int:
        i = bisect_left(self.starts, e) - overlap
        return self.starts[i] if 0 <= i < len(self.starts) else (0 if i < 0 else e)


def cut(text: str, limit: int = 2000, overlap: int = 200, unit: str = "chars") -> list[tuple[int, int, bool]]:
    """Pieces (start, end, forced) of text, in order.

    A piece ends before the last boundary within limit, or is forced to end at
    the limit where there is none. The next piece starts at the first boundary
    within overlap of that end, else overlap before it, but later if from there
    the next boundary were out of reach. The boundary character itself may lie
    between two pieces; all else is in a piece. So a forced end occurs exactly
    where a stretch between neighbouring boundaries is itself over the limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under limit")
    n = len(text)
    m = _Chars(text) if unit == "chars" else _Tokens(text)
    if n == 0:
        return []
    if m.size(0, n) <= limit:
        return [(0, n, False)]
    marks = [x.start() for x in BOUNDARY.finditer(text)]
    pieces, s = [], 0
    while True:
        if m.size(s, n) <= limit:
            if s < n:
                pieces.append((s, n, False))
            return pieces
        i = bisect_right(marks, m.reach(s, limit)) - 1
        last = pieces[-1][1] if pieces else 0
        forced = i < 0 or marks[i] <= max(s, last)
        if forced and i >= 0 and marks[i] == s:
            s += 1  # a boundary at the very start lies between pieces and takes no room in one
            continue
        e = m.reach(s, limit) if forced else marks[i]
        pieces.append((s, e, forced))
        after = e if forced else e + 1
        j = bisect_right(marks, e)
        ahead = marks[j] if j < len(marks) else n
        least = max(m.back(e, overlap), s + 1)
        k = bisect_left(marks, least)
        starts = [marks[x] + 1 for x in range(k, bisect_left(marks, e)) if least <= marks[x] + 1 < e]
        starts = starts or [least]
        s = next((x for x in starts if m.size(x, ahead) <= limit), starts[0] if m.size(after, ahead) > limit else after)


def split_texts(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), limit: int = 2000, overlap: int = 200, unit: str = "chars") -> DataFrame:
    """Pieces of every text: (id, keep..., piece_no, n_pieces, start, end, forced, cut, piece).

    start and end are code point offsets into the text; forced says that this
    piece's end is no boundary, cut is 'forced' if any end of its text is, else
    'natural'. A text within limit is one piece. Null ids and null or empty
    texts have no piece. A repeated id counts once, with the least of its kept
    values and the greatest of its texts over the limit, or of all if none is.
    Only texts over the limit go to Python; where only these are asked for
    (n_pieces > 1), no other text is read on or shuffled.
    """
    rows = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"))

    def once(part: DataFrame) -> DataFrame:
        return part.groupBy("id").agg(*[F.min(c).alias(c) for c in keep], F.max("text").alias("text")).select("id", *keep, "text")

    # A text of at most limit characters has no more tokens than that either, and is one piece.
    long = rows.where(F.length("text") > limit)
    kept = "".join(f"`{c}` {t}, " for c, t in rows.select(*keep).dtypes) if keep else ""
    id_type = dict(rows.dtypes)["id"]
    schema = f"id {id_type}, {kept}piece_no int, n_pieces int, `start` int, `end` int, forced boolean, cut string, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            src: list[int] = []
            cols: list[list] = [[] for _ in range(7)]
            for row, text in enumerate(texts):
                pieces = cut(text, limit, overlap, unit)
                how = "forced" if any(p[2] for p in pieces) else "natural"
                for no, (s, e, forced) in enumerate(pieces):
                    src.append(row)
                    for c, v in zip(cols, (no, len(pieces), s, e, forced, how, text[s:e])):
                        c.append(v)
            take = pa.array(src, pa.int32())
            head = [batch.column("id").take(take), *[batch.column(c).take(take) for c in keep]]
            types = [pa.int32()] * 4 + [pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*head, *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["id", *keep, "piece_no", "n_pieces", "start", "end", "forced", "cut", "piece"],
            )

    cut_up = once(long).mapInArrow(run, schema)
    short = once(rows.where(F.length("text") <= limit).join(long.select("id").distinct(), "id", "left_anti"))
    zero = F.lit(0)
    whole = short.select(
        "id", *keep, zero.alias("piece_no"), F.lit(1).alias("n_pieces"), zero.alias("start"), F.length("text").alias("end"),
        F.lit(False).alias("forced"), F.lit("natural").alias("cut"), F.col("text").alias("piece"),
    )
    return cut_up.unionByName(whole)
