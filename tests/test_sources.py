import gzip
import io
import json
import os
import tarfile
import time

import pytest

from folioscan.operators import ingest as G
from folioscan.operators import metadata as M
from folioscan.operators.jobs import Jobs, within
from folioscan.runtime import durable, release, shared_dir
from folioscan.sources import archives as A
from folioscan.sources import harvest as H
from folioscan.sources import records as R
from folioscan.streaming.ingest import ingest, read_arrivals

TEX = r"""\documentclass{article}
\title{On \emph{Rings}} \author{A. One, B. Two and C. Three}
\begin{document}
\begin{abstract}We study $x$.\end{abstract}
\section{Start} % a comment
First paragraph with $a+b$ in it.

\begin{align*}
x &= 1 \\
y &= \frac{1}{2}
\end{align*}

Last one \cite{foo}.
\end{document}
"""


def tar(**files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, text in files.items():
            info = tarfile.TarInfo(name.replace("__", "/").replace("_dot_", "."))
            data = text.encode()
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "archives" / "deep"
    d.mkdir(parents=True)
    (d / "0704.0001v1.tar.gz").write_bytes(tar(main_dot_tex=TEX, sub__b_dot_tex="no body here", refs_dot_bbl="Ref"))
    (d / "math_0404297.gz").write_bytes(gzip.compress(TEX.encode()))
    (d / "0705.1.TGZ").write_bytes(tar(x_dot_txt="nothing"))
    (d / "0706.2.tar.gz").write_bytes(tar(**{"..__evil_dot_tex": TEX}))
    (d / "0707.3.gz").write_bytes(b"broken")
    (d / "readme.txt").write_text("no archive")
    return str(tmp_path / "archives")


def test_archives(spark, root):
    assert sorted(r.arxiv_id for r in A.scan_archives(spark, root).collect()) == ["0704.0001v1", "0705.1.TGZ", "0706.2", "0707.3", "math_0404297"]
    rows = A.vectorize(spark, root).collect()
    own = sorted((r for r in rows if r.arxiv_id == "0704.0001v1"), key=lambda r: int(r.id[6:]))
    assert {r.arxiv_id for r in rows} == {"0704.0001v1", "math_0404297"}
    assert [r.id for r in own] == [f"chunk_{i}" for i in range(len(own))]
    kinds = [r.kind for r in own]
    assert kinds == sorted(kinds, reverse=True) and kinds.count("equation") == 3
    text = " ".join(r.text for r in own if r.kind == "paragraph")
    assert "comment" not in text and "foo" in text and "no body here" in text and "[MATH_" in text
    align = next(r for r in own if "align" in r.text)
    assert "\\frac" in align.tokens and align.math == align.tokens
    present = spark.createDataFrame([("0704.0001v1",)], "arxiv_id string")
    assert {r.arxiv_id for r in A.vectorize(spark, root, present).collect()} == {"math_0404297"}
    texts = {r.arxiv_id: r.text for r in A.latex_texts(spark, root).collect()}
    assert texts["0704.0001v1"].endswith("Ref") and "% a comment" not in texts["0704.0001v1"]


def test_broken_archives_and_large_members():
    whole = tar(a_dot_tex="x" * 100_000, b_dot_tex="y")
    assert [n for n, _ in A.members(whole, "p.tar.gz", (".tex",), 1_000)] == ["b.tex"]
    assert list(A.members(whole[: len(whole) // 2], "p.tar.gz", (".tex",))) == [] and list(A.members(b"", "p.gz", (".tex",))) == []


def test_take_math():
    assert A.take_math("p\n\\begin{equation}\n\\begin{align}\n1\n\\end{align}\n2") == ("p\n [MATH_0] \n\\begin{equation}\n2", ["\\begin{align}\n1\n\\end{align}"])
    assert A.take_math("\n\nq\n\\begin{equation}\n1\n\\end{equation}\n\nz\n") == ("\n\nq\n [MATH_0] \n\nz", ["\\begin{equation}\n1\n\\end{equation}"])
    assert A.take_math("") == ("", []) and A.take_math("\\begin{align}") == ("\\begin{align}", [])
    assert A.take_math("\\begin{proof} \\begin{align}\n\\end{align}")[1] == []
    prose, blocks = A.take_math("a $x$ b\n\\begin{align}\n1\n\\begin{gather}\n2\n\\end{gather}\n3\n\\end{align}\nc\n\\begin{equation}\nopen")
    assert blocks == ["$x$", "\\begin{gather}\n2\n\\end{gather}", "\\begin{align}\n1\n3\n\\end{align}"]
    assert prose.split("\n")[-2:] == ["\\begin{equation}", "open"] and "[MATH_1]" in prose
    assert A.take_math("\\begin{align} x \\end{align}\ny")[1] == []


def test_metadata(spark):
    latex = spark.createDataFrame([("1", TEX), ("2", "  "), ("3", None)], "arxiv_id string, text string")
    row = M.from_latex(latex).collect()
    assert [(r.arxiv_id, r.title, r.authors, r.abstract) for r in row] == [("1", "On Rings", ["A. One", "B. Two", "C. Three"], "We study $x$.")]
    assert M.argument(r"\Title {On \emph{the \textbf{big} ring}, $x^{2}$} {z}", "title") == r"On \emph{the \textbf{big} ring}, $x^{2}$"
    assert M.display_text(r"On \emph{the \textbf{big} ring}, {x} \LaTeX y") == "On the big ring, x y" and M.argument(r"\title{open", "title") == ""
    chunks = spark.createDataFrame([("4", "chunk_1", "Paragraph ", " second "), ("4", "chunk_0", "equation", "first"), ("5", "chunk_0", None, "any"), ("6", "chunk_0", "paragraph", None)], "arxiv_id string, id string, kind string, text string")
    assert {(r.arxiv_id, r.abstract) for r in M.from_chunks(chunks).collect()} == {("4", "second"), ("5", "any")}
    cache = spark.createDataFrame([("1v1", "old", None, None, "a", None, "api", 1), ("1", "new", ["x"], ["s"], "b", "d", "api", 2), (None, "n", None, None, None, None, None, None)], "arxiv_id string, title string, authors array<string>, subjects array<string>, abstract string, doi string, source string, ts long")
    ids = spark.createDataFrame([("1v3",), ("4",), ("9",), (None,)], "arxiv_id string")
    got = {(r.arxiv_id, r.title, r.source) for r in M.paper_metadata(ids, cache, latex, chunks).collect()}
    assert got == {("1", "new", "api"), ("4", "4", "offline")}


def test_records(spark, tmp_path):
    folder = tmp_path / "v" / "0704.0001"
    folder.mkdir(parents=True)
    good = {"id": "chunk_0", "kind": "paragraph", "text": "a", "math": [], "tokens": ["a"]}
    (folder / "chunks.jsonl").write_text(json.dumps(good) + "\nnot json\n[1]\n")
    assert [(r.arxiv_id, r.id, r.tokens) for r in R.read_chunks(spark, str(tmp_path / "v")).collect()] == [("0704.0001", "chunk_0", ["a"])]
    vectors = spark.createDataFrame([(1, [0.5]), (2, [1.0])], "chunk_id long, v array<double>")
    R.write_embeddings(vectors, str(tmp_path / "e"))
    assert R.read_embeddings(spark, str(tmp_path / "e"), vectors.where("chunk_id = 2")).count() == 1
    (tmp_path / "allow").write_text("a\n\n b \n")
    assert R.read_allowlist(spark, str(tmp_path / "allow")).count() == 2


def chunks(spark, *papers):
    return spark.createDataFrame([(p, f"chunk_{i}", "paragraph", "t", [], ["t", p]) for p in papers for i in range(12)], R.CHUNK_SCHEMA and "arxiv_id string, id string, kind string, text string, math array<string>, tokens array<string>")


def test_choosing(spark, tmp_path):
    rows = chunks(spark, "a", "b", "c")
    ids = spark.createDataFrame([("b",), ("b",), (None,)], "arxiv_id string")
    assert G.allowlisted(rows, ids).count() == 12 and G.not_yet_present(rows, ids).count() == 24
    assert {r.arxiv_id for r in G.first_papers(rows, 2).collect()} == {"a", "b"}
    mini = G.mini_dataset(rows, 1, 11).collect()
    assert sorted((int(r.id[6:]) for r in mini)) == list(range(11))
    present = G.build(rows, allowed=ids)
    assert present.n_chunks == 12 and G.build(rows, "incremental", present).n_chunks == 36
    assert G.build(rows, "recent", present).n_chunks == 24 and G.build(rows, limit=1).n_chunks == 12
    G.append_manifest(str(tmp_path / "m"), rows)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3
    with pytest.raises(ValueError):
        G.build(rows, "other")


def test_stream(spark, tmp_path):
    store, arrivals = str(tmp_path / "store"), tmp_path / "in"
    for n, papers in enumerate((("a", "b"), ("b", "c"))):
        chunks(spark, *papers).coalesce(1).write.mode("append").json(str(arrivals))
        ingest(read_arrivals(spark, str(arrivals)), store, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(store).count() == (24, 36)[n]


def test_harvest(spark, tmp_path):
    page = '<OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>{}<resumptionToken>{}</resumptionToken></ListRecords></OAI-PMH>'
    record = "<record><header{}><identifier>oai:x:{}</identifier></header></record>"
    pages = [page.format(record.format("", "1") + record.format(' status="deleted"', "2"), "next"), page.format(record.format("", "math/3"), "")]
    asked = []

    def fetch(address):
        asked.append(address)
        return pages[len(asked) - 1].encode()

    assert list(H.listing(fetch, "http://host/oai", delay=0)) == ["1", "math/3"] and "resumptionToken=next" in asked[1]
    assert H.parse_listing(b"broken") == ([], None)
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "p.xml").write_text(pages[0])
    assert [r.arxiv_id for r in H.read_listings(spark, str(tmp_path / "l")).collect()] == ["1"]
    feed = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/abs/math/1v2</id><title>A  b</title><summary> s </summary><author><name>N</name></author><category term="math.AT"/></entry></feed>'
    want = {"arxiv_id": "math/1", "title": "A b", "authors": ["N"], "subjects": ["math.AT"], "abstract": "s", "doi": None, "source": "arxiv", "ts": 5}
    assert H.parse_feed(feed.encode(), 5) == [want]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.xml").write_text(feed)
    (tmp_path / "f" / "b.xml").write_text("broken")
    assert [r.asDict() | {"ts": 5} for r in H.read_feeds(spark, str(tmp_path / "f")).collect()] == [want]


def test_fetching_reports_every_id(spark, tmp_path):
    entry = "<entry><id>http://x/abs/{}</id><title>t</title></entry>"

    def fetch(address):
        if "bad" in address:
            raise OSError("down")
        names = [n for n in ("1", "2") if n in address]
        return ('<feed xmlns="http://www.w3.org/2005/Atom">' + "".join(map(entry.format, names)) + "</feed>").encode()

    ids = spark.createDataFrame([("1v1",), ("2",), ("3",), ("bad",), (None,)], "arxiv_id string").coalesce(1)
    cache = str(tmp_path / "cache")
    first = {r.asked: r.error for r in H.refresh_metadata(ids, cache, fetch, "http://h", 1).collect()}
    assert first == {"1": None, "2": None, "3": "absent", "bad": "OSError: down"}
    assert {r.arxiv_id for r in spark.read.parquet(cache).collect()} == {"1", "2"}
    assert {r.asked for r in H.refresh_metadata(ids, cache, fetch, "http://h", 1).collect()} == {"3", "bad"}
    got = {r.arxiv_id: (r.status, r.content) for r in H.download(ids, fetch, lambda a: f"http://h/{a}", ids.where("arxiv_id = '3'")).collect()}
    assert got["3"] == ("skip", None) and got["bad"] == ("err:OSError", None) and got["2"][0] == "ok" and got["2"][1].startswith(b"<feed")
    text = gzip.compress(TEX.encode())
    table = H.download(ids.where("arxiv_id = '2'"), lambda a: text, lambda a: a).where("status = 'ok'")
    assert [(r.arxiv_id, r.member) for r in A.archive_members(table).collect()] == [("2", "main.tex")]


def test_jobs(spark, tmp_path):
    jobs = Jobs(spark, str(tmp_path))
    assert jobs.status("build") == {"state": "idle"}
    job = jobs.start("build", lambda report: (report(done=1), time.sleep(0.5)))
    assert job and jobs.start("build", lambda report: None) is None
    jobs.wait("build", 10)
    assert jobs.status("build")["state"] == "done" and jobs.progress("build") == {}
    jobs.run_all("count", lambda: spark.range(100).count(), lambda n: {"rows": n})
    jobs.wait("count", 60)
    assert jobs.status("count")["rows"] == 100
    jobs.start("build", lambda report: 1 / 0)
    jobs.wait("build", 10)
    assert jobs.status("build")["state"] == "failed"
    assert within(spark, 60, lambda: spark.range(10).count()) == 10


def test_durable(spark):
    df = durable(spark.range(5), "t")
    path = df.inputFiles()[0]
    assert df.count() == 5 and shared_dir(spark).removeprefix("file:") in path
    release(spark)
    assert not os.path.exists(path.removeprefix("file://"))
