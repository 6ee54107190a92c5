"""Small inputs of forms that the tables lack: archives of LaTeX sources and queries with formulas, each with what must come of it."""

from __future__ import annotations

import gzip
import io
import json
import tarfile
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from folioscan.runtime import scratch_path, write_bytes

MAIN = r"""\documentclass{article}
\title{On \emph{Noetherian \textbf{Rings}}}
\author{A. One, B. {van} Two; C. Three and D. Four}
\begin{document}
\begin{abstract}We study $x$ and \emph{its \textbf{powers}}.\end{abstract}
\section{Start} % a comment
Let $a+b$ be given.

\begin{align*}
u &= 1 \\
\begin{gather}
v = \alpha
\end{gather}
y &= 2
\end{align*}

Last \cite{foo}.
\begin{equation} never closed \end{equation}
\end{document}
"""
OTHER = "Only prose here, on 50\\% of it.\n% all comment\n"
SINGLE = "\\begin{document}\nA single file with \\(c\\).\n\\end{document}\n"

#: Query texts with formulas, symbols, operators, hints, placeholders and nothing at all.
QUERIES = (
    "phases of the classes", "for all α ≤ β", "the integral $a <= b$", "ℝ ‖ ℝ", "[MATH_3] $\\varepsilon$ and \\(x^{2}\\)", "", "sum -> product", "if and only if $$\\Sum_{i=1} i$$",
    "∇ · ∂ in Ω there exists", "$\\begin{matrix} a \\\\ b \\end{matrix}$", "a<<b >> c != d", "theories – and math_12 boxes \u2212 x", "Gradient SUBSET partial",
)


def _tar(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def archive_folder(spark: SparkSession) -> str:
    """A folder of archives of every kind: several files, one file, a path outside its root, no LaTeX, and one that is broken."""
    return _folder(spark, {
        "deep/0704.0001v1.tar.gz": _tar({"sub/main.tex": MAIN, "other.tex": OTHER, "refs.bbl": "A reference."}),
        "math_0404297.gz": gzip.compress(SINGLE.encode()),
        "0705.0002.TGZ": _tar({"notes.txt": "nothing"}),
        "0706.0003.tar.gz": _tar({"../evil.tex": MAIN}),
        "0707.0004.gz": b"broken",
        "readme.txt": b"no archive",
    })


def _folder(spark: SparkSession, files: dict[str, bytes]) -> str:
    root = scratch_path(spark, "fixture")
    for name, data in files.items():
        write_bytes(spark, f"{root}/{name}", data)
    return root


def record_folder(spark: SparkSession) -> str:
    """Chunk records of two papers as JSON lines, with lines that are none."""
    one = {"id": "chunk_0", "kind": "paragraph", "text": "a b", "math": [], "tokens": ["a", "b"]}
    two = {"id": "chunk_1", "kind": "equation", "text": "$x$", "math": ["x"], "tokens": ["x"]}
    lines = lambda *rows: "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows).encode()
    return _folder(spark, {"0704.0001v1/chunks.jsonl": lines(one, "not json", "[1]", two), "math_0404297/chunks.jsonl": lines(two, "{}")})


def listing_folder(spark: SparkSession) -> str:
    record = "<record><header{}><identifier>oai:x:{}</identifier></header></record>"
    page = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{}</ListRecords></OAI-PMH>'
    deleted = ' status="deleted"'
    return _folder(spark, {"a.xml": page.format(record.format("", "0704.0001") + record.format(deleted, "0704.0002")).encode(), "b.xml": page.format(record.format("", "math/0404297")).encode(), "c.xml": b"broken"})


def feed(ids: list[str]) -> bytes:
    """An Atom feed with a record for each id."""
    entry = (
        "<entry><id>http://host/abs/{0}</id><title>Paper  {0}</title><summary> About\n{0} </summary><author><name>A</name></author>"
        '<author><name> </name></author><category term="math.AC"/><arxiv:doi>10/{0}</arxiv:doi></entry>'
    )
    return f"""<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">{''.join(entry.format(i) for i in ids)}</feed>""".encode()


def fetch(address: str) -> bytes:
    """The answer of a metadata service that knows every id but those that end in 7."""
    return feed([i for i in parse_qs(urlsplit(address).query)["id_list"][0].split(",") if not i.endswith("7")])


def feed_folder(spark: SparkSession) -> str:
    return _folder(spark, {"a.xml": feed(["0704.0001v2", "math/0404297"]), "b.xml": b"broken"})
