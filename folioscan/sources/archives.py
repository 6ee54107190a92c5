"""LaTeX archives: scanning, unpacking in memory, choosing main files, and cutting them into chunk records."""

from __future__ import annotations

import gzip
import io
import posixpath
import re
import tarfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import hints
from folioscan.functions import text as T

_SUFFIX = r"(?:\.tar\.gz|\.tgz|\.gz)$"


def archive_id(path: Column) -> Column:
    """A paper's id: the file name without its archive suffix, which is compared with its case."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), _SUFFIX, "")


def scan_archives(spark: SparkSession, root: str) -> DataFrame:
    """(path, arxiv_id, content) of all archives under root, suffixes in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(F.lower("path").rlike(_SUFFIX))
    return files.select("path", archive_id(F.col("path")).alias("arxiv_id"), "content")


def members(content: bytes, name: str, suffixes: tuple[str, ...] = ("",), most_bytes: int | None = None) -> Iterator[tuple[str, bytes]]:
    """Members (path, bytes) with a suffix and under most_bytes, one at a time: of a tar, plain or compressed, else the one file that it is.

    Names and sizes are read before any member is. A tar with a member outside
    its root has no members; one that breaks off gives those before the break. A
    single file is main.tex if it looks like LaTeX, paper.pdf if like a PDF.
    """

    def wanted(path: str, size: int) -> bool:
        return path.lower().endswith(suffixes) and (most_bytes is None or size < most_bytes)

    try:
        tar = tarfile.open(fileobj=io.BytesIO(content), mode="r:*")
        files = [m for m in tar.getmembers() if m.isfile()]
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        yield from ((n, d) for n, d in _single(content, name) if wanted(n, len(d)))
        return
    with tar:
        if any(posixpath.normpath(m.name).startswith(("/", "..")) for m in files):
            return
        for m in files:
            if wanted(m.name, m.size):
                try:
                    yield m.name, tar.extractfile(m).read()
                except (tarfile.TarError, EOFError, OSError, zlib.error):
                    return


def _single(content: bytes, name: str) -> list[tuple[str, bytes]]:
    try:
        data = gzip.decompress(content)
    except (OSError, EOFError, zlib.error):
        data = content
    head = data[:512].decode("utf-8", "ignore")
    out = re.sub(r"\.gz$", "", name)
    if ("\\documentclass" in head or "\\begin{document}" in head) and not out.endswith(".tex"):
        out = "main.tex"
    elif head.startswith("%PDF") and not out.endswith(".pdf"):
        out = "paper.pdf"
    return [(out, data)]


def archive_members(archives: DataFrame, suffixes: tuple[str, ...] = (".tex",), most_bytes: int | None = None) -> DataFrame:
    """(arxiv_id, member, text) of members with a suffix, decoded as UTF-8 without what is not; larger ones left out.

    An archive that can't be read has no members and stops no other. A task holds one member at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["arxiv_id", "member", "text"]
        for batch in batches:
            for i in range(batch.num_rows):
                paper, path = batch.column("arxiv_id")[i].as_py(), batch.column("path")[i].as_py()
                for member, data in members(batch.column("content")[i].as_py() or b"", path.rsplit("/", 1)[-1], suffixes, most_bytes):
                    row = [pa.array([x], pa.string()) for x in (paper, member, data.decode("utf-8", "ignore"))]
                    yield pa.RecordBatch.from_arrays(row, names=names)

    return archives.select("path", "arxiv_id", "content").mapInArrow(run, "arxiv_id string, member string, text string")


def main_files(members: DataFrame, keep: int = 5) -> DataFrame:
    """members with place, 1 to keep: those with a document body and many sections first, then the longest, then by path, descending."""
    sections = F.least(F.lit(5), F.regexp_count("text", F.lit(r"\\section")))
    score = F.when(F.contains("text", F.lit("\\begin{document}")), 10).otherwise(0) + sections
    order = Window.partitionBy("arxiv_id").orderBy(score.desc(), F.length("text").desc(), F.col("member").desc())
    return members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)


def combined_sources(members: DataFrame, keep: int = 5) -> DataFrame:
    """(arxiv_id, tex): the main files of each paper in order, with a blank line between."""
    files = main_files(members, keep).groupBy("arxiv_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("f"))
    return files.select("arxiv_id", F.array_join("f.text", "\n\n").alias("tex"))


_FORMULA = re.compile(T.MATH)
#: A line with the first environment that it opens and the first that it closes.
_LINE = re.compile(r"^(?=.*?\\begin\{(?P<opens>[A-Za-z*]+)\}|)(?=.*?\\end\{(?P<closes>[A-Za-z*]+)\}|).*$", re.M)


def environments(text: str) -> tuple[list[tuple[int, int]], int]:
    """Offsets (start, end) of the lines of each math environment that closes, in the order of closing, and where the first starts that never does.

    A line opens by its first begin, if that is of a math environment, and then
    closes nothing; else it closes the innermost open one if its first end is of that name.
    """
    closed: list[tuple[int, int]] = []
    pending: list[tuple[str, int]] = []
    for line in _LINE.finditer(text):
        if line["opens"] in hints.MATH_ENVIRONMENTS:
            pending.append((line["opens"], line.start()))
        elif pending and pending[-1][0] == line["closes"]:
            closed.append((pending.pop()[1], line.end()))
    return closed, pending[0][1] if pending else len(text) + 1


def _outside(text: str, start: int, end: int, holes: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """The whole lines of text[start:end] that lie in no hole, as (offset, lines)."""
    parts, at = [], start
    for s, e in sorted(holes):
        if s > at:
            parts.append((at, text[at : s - 1]))
        at = max(at, e + 1)
    return [*parts, (at, text[at:end])] if at <= end else parts


def take_math(tex: str) -> tuple[str, list[str]]:
    """tex with formulas and math environments replaced by numbered placeholders, and those in order.

    Delimited formulas are numbered first, then environments in the order in
    which they close. An environment inside another is a block of its own and no part of
    the outer one; its placeholder stands before that of the outer one. Lines from
    the first environment that never closes come out as text at the end.
    """
    formulas = _FORMULA.findall(tex)
    numbers = iter(range(len(formulas)))
    text = "\n".join(_FORMULA.sub(lambda _: f" [MATH_{next(numbers)}] ", tex).splitlines())
    spans, rest = environments(text)
    blocks = ["\n".join(p for _, p in _outside(text, s, e, [x for x in spans if s < x[0] and x[1] <= e])) for s, e in spans]
    holders = [(end, f" [MATH_{len(formulas) + n}] ") for n, (_, end) in enumerate(spans)]
    prose = sorted(_outside(text, 0, min(rest - 1, len(text)), [x for x in spans if x[0] < rest]) + holders) if rest else sorted(holders)
    tail = _outside(text, rest, len(text), [x for x in spans if x[0] > rest]) if rest <= len(text) else []
    return "\n".join(p for _, p in [*prose, *tail]), formulas + blocks


def separate_math(sources: DataFrame) -> DataFrame:
    """(arxiv_id, prose, blocks) of sources (arxiv_id, tex), comments stripped first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [take_math(t or "") for t in batch.column("tex").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("arxiv_id"), pa.array([p for p, _ in parts], pa.string()), pa.array([b for _, b in parts], pa.list_(pa.string()))],
                names=["arxiv_id", "prose", "blocks"],
            )

    stripped = sources.select("arxiv_id", T.strip_comments(F.col("tex")).alias("tex"))
    return stripped.mapInArrow(run, "arxiv_id string, prose string, blocks array<string>")


def chunk_sources(sources: DataFrame, drop_latex_args: bool = False, math_hint_compat: bool = False) -> DataFrame:
    """Chunk records (arxiv_id, id, kind, text, math, tokens): the paragraphs of each paper, then its formulas, numbered through."""
    parts = separate_math(sources)
    clean = F.filter(F.transform(T.paragraphs(F.col("prose")), lambda p: T.latex_to_text(p, drop_latex_args)), lambda p: p != "")
    formulas = F.filter("blocks", lambda b: F.size(T.math_tokens(b)) > 0)
    parts = parts.select("arxiv_id", clean.alias("paras"), formulas.alias("formulas"))
    prose = parts.select("arxiv_id", F.posexplode("paras").alias("n", "text")).withColumn("kind", F.lit("paragraph"))
    first = parts.select("arxiv_id", F.size("paras").alias("_n"), F.posexplode("formulas").alias("n", "text"))
    math = first.select("arxiv_id", (F.col("_n") + F.col("n")).alias("n"), "text", F.lit("equation").alias("kind"))
    rows = prose.unionByName(math).withColumn("tokens", T.chunk_tokens(F.col("text"), F.col("kind"), math_hint_compat))
    empty = F.array().cast("array<string>")
    return rows.select(
        "arxiv_id", F.concat(F.lit("chunk_"), F.col("n").cast("string")).alias("id"), "kind", "text",
        F.when(F.col("kind") == "equation", F.col("tokens")).otherwise(empty).alias("math"), "tokens",
    )


def vectorize(spark: SparkSession, root: str, present: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Chunk records of the archives under root, without papers in present (arxiv_id), then only the first limit by path."""
    archives = scan_archives(spark, root)
    if present is not None:
        archives = archives.join(present.select("arxiv_id").distinct(), "arxiv_id", "left_anti")
    if limit is not None:
        archives = archives.join(archives.select("path").orderBy("path").limit(limit), "path", "left_semi")
    return chunk_sources(combined_sources(archive_members(archives)))


def latex_texts(spark: SparkSession, root: str) -> DataFrame:
    """(arxiv_id, text): the .tex, then .bbl files of each paper under root, comments stripped leniently.

    A paper's folder comes before an archive of its name; archive members of
    5 MB or more are left out.
    """
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    parts = F.split(F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", ""), "/")
    loose = plain.where(F.lower("path").rlike(r"\.(tex|bbl)$")).withColumn("_p", parts).where(F.size("_p") > 1)
    loose = loose.select(F.element_at("_p", 1).alias("arxiv_id"), F.col("path").alias("member"), F.decode("content", "UTF-8").alias("text"), F.lit(0).alias("_s"))
    packed = plain.where(F.lower("path").rlike(r"(?:\.tar\.gz|\.tgz|\.tar)$"))
    packed = packed.select("path", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?:\.tar\.gz|\.tgz|\.tar)$", "").alias("arxiv_id"), "content")
    members = archive_members(packed, (".tex", ".bbl"), 5_000_000).withColumn("_s", F.lit(1))
    every = loose.unionByName(members).withColumn("_best", F.min("_s").over(Window.partitionBy("arxiv_id"))).where("_s = _best")
    order = F.struct(F.lower("member").endswith(".bbl").alias("b"), "member", "text")
    joined = every.groupBy("arxiv_id").agg(F.array_sort(F.collect_list(order)).alias("f"))
    return joined.select("arxiv_id", T.strip_comments_lenient(F.array_join("f.text", "\n\n")).alias("text"))
