"""Paper metadata: the latest cached record, else what a paper's own text gives."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.functions import text as T

_FIELDS = ("arxiv_id", "title", "authors", "subjects", "abstract", "doi", "source", "ts")


def latest_records(cache: DataFrame) -> DataFrame:
    """One record per normalised id: the one of greatest ts, ties by the least of the other values. Null ids are left out."""
    rows = cache.withColumn("arxiv_id", T.normal_id(F.col("arxiv_id"))).where("arxiv_id is not null")
    order = [F.col("ts").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("title", "abstract", "doi", "source", "authors", "subjects")]]
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("arxiv_id").orderBy(*order)))
    return ranked.where("_r = 1").select(*_FIELDS)


_COMMAND = r"\\[a-zA-Z@]+\*?\s*(?:\[[^\]]*\]\s*)?"
_PIECE = re.compile(rf"(?P<taken>{_COMMAND}\{{)|(?P<command>{_COMMAND})|(?P<open>\{{)|(?P<close>\}})|(?P<text>[^\\{{}}]+|\\)")
_BRACE = re.compile(r"\\.|[{}]", re.S)


def argument(tex: str, command: str) -> str:
    """What the braces after a command's first use hold, up to the brace that matches; empty if there is none."""
    start = re.search(rf"\\{command}\s*\{{", tex, re.I)
    depth = 1
    for brace in _BRACE.finditer(tex, start.end()) if start else ():
        depth += {"{": 1, "}": -1}.get(brace[0], 0)
        if not depth:
            return tex[start.end() : brace.start()].strip()
    return ""


def display_text(tex: str) -> str:
    """LaTeX for display, in one scan: a command before a brace goes with its pair of braces, any other is a space, as is a brace of its own."""
    out, silent = [], []
    for piece in _PIECE.finditer(tex):
        if piece.lastgroup == "taken":
            silent.append(True)
        elif piece.lastgroup == "open":
            silent.append(False)
            out.append(" ")
        elif piece.lastgroup == "close":
            out += [] if silent and silent.pop() else [" "]
        else:
            out.append(" " if piece.lastgroup == "command" else piece[0])
    return " ".join("".join(out).split())


def from_latex(latex: DataFrame) -> DataFrame:
    """Records from sources (arxiv_id, text): title (else the id), authors split at commas, semicolons and 'and', abstract of at most 1,200 characters.

    Arguments run to the brace that matches, so they may hold commands with
    braces. A null, empty or blank text has no record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            bodies = [re.search(r"\\begin\{abstract\}(.*?)\\end\{abstract\}", t, re.S | re.I) for t in texts]
            names = [re.split(r"[;,]|\band\b", display_text(argument(t, "author"))) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("arxiv_id"),
                    pa.array([display_text(argument(t, "title")) for t in texts], pa.string()),
                    pa.array([[n.strip() for n in people if n.strip()] for people in names], pa.list_(pa.string())),
                    pa.array([display_text(b[1])[:1200] if b else "" for b in bodies], pa.string()),
                ],
                names=["arxiv_id", "title", "authors", "abstract"],
            )

    heads = latex.where(F.length(F.trim("text")) > 0).select(F.col("arxiv_id").cast("string"), "text")
    return heads.mapInArrow(run, "arxiv_id string, title string, authors array<string>, abstract string").select(
        "arxiv_id", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("arxiv_id")).alias("title"), "authors",
        F.array().cast("array<string>").alias("subjects"), "abstract", F.lit(None).cast("string").alias("doi"),
        F.lit("offline_latex").alias("source"), F.lit(0).cast("long").alias("ts"),
    )


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Records from chunk records (arxiv_id, id, kind, text): the first paragraph, else the first text, of at most 1,200 characters."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    order = F.struct(T.clean_kind(F.col("kind")).eqNullSafe("paragraph").cast("int").alias("p"), (-F.regexp_extract("id", r"(\d+)$", 1).cast("long")).alias("n"))
    rows = chunks.where(F.col("arxiv_id").isNotNull() & (F.length(text) > 0))
    best = rows.groupBy("arxiv_id").agg(F.max_by(F.substring(text, 1, 1200), order).alias("abstract"))
    empty = F.array().cast("array<string>")
    return best.select(
        "arxiv_id", F.col("arxiv_id").alias("title"), empty.alias("authors"), empty.alias("subjects"), "abstract",
        F.lit(None).cast("string").alias("doi"), F.lit("offline").alias("source"), F.lit(0).cast("long").alias("ts"),
    )


def paper_metadata(ids: DataFrame, cache: DataFrame, latex: DataFrame | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """A record for every id of ids (arxiv_id) that any source knows: the cache first, then LaTeX, then chunks."""
    wanted = ids.select(T.normal_id(F.col("arxiv_id")).alias("arxiv_id")).where("arxiv_id is not null").distinct()
    ranked = [latest_records(cache).withColumn("_s", F.lit(0))]
    for n, extra in enumerate(x for x in (latex and from_latex(latex), chunks and from_chunks(chunks)) if x is not None):
        ranked.append(extra.withColumn("arxiv_id", T.normal_id(F.col("arxiv_id"))).select(*_FIELDS, F.lit(n + 1).alias("_s")))
    every = ranked[0]
    for other in ranked[1:]:
        every = every.unionByName(other)
    best = Window.partitionBy("arxiv_id").orderBy("_s", "title")
    return every.join(wanted, "arxiv_id", "left_semi").withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_s")


def metadata_cards(meta: DataFrame) -> DataFrame:
    """(arxiv_id, title, authors_line, subjects_line, abstract_head, abs_url, pdf_url) for display."""
    return meta.select(
        "arxiv_id", F.trim(F.coalesce("title", "arxiv_id")).alias("title"), T.authors_line(F.col("authors")).alias("authors_line"),
        F.array_join(F.slice(F.coalesce("subjects", F.array().cast("array<string>")), 1, 3), " ").alias("subjects_line"),
        T.abstract_preview(F.col("abstract")).alias("abstract_head"), T.paper_url(F.col("arxiv_id")).alias("abs_url"),
        T.paper_url(F.col("arxiv_id"), "pdf").alias("pdf_url"),
    )
