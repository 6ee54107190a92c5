import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscan.llm import markup, queries, repetition as rep
from folioscan.llm.splitting import BOUNDARY, TOKEN, cut, split_texts

PROSE = st.text(alphabet="ab .!\n\\;é\U0001d54f", max_size=400)


@settings(max_examples=300, deadline=None)
@given(PROSE, st.integers(5, 60), st.integers(0, 4))
def test_cut(text, limit, overlap):
    pieces = cut(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e, _ in pieces)
    marks = {m.start() for m in BOUNDARY.finditer(text)}
    at = 0
    for i, (s, e, forced) in enumerate(pieces):
        assert s <= at + 1 and (s <= at or at in marks), "only a boundary lies between pieces"
        assert i == 0 or (e > at and at - s <= overlap)
        assert forced or e in marks or e == len(text)
        at = e
    assert at == len(text) or (at == len(text) - 1 and at in marks) or not pieces
    edges = [-1, *sorted(marks), len(text)]
    long_stretch = any(b - a - 1 > limit for a, b in zip(edges, edges[1:]))
    assert any(p[2] for p in pieces) == long_stretch


def test_boundary_at_the_start_takes_no_room():
    assert cut("\n;;;;;", 5, 0) == [(1, 6, False)]
    assert cut("\n" + "x" * 2000) == [(1, 2001, False)]
    assert any(p[2] for p in cut("\n" + "x" * 2001))


@settings(max_examples=100, deadline=None)
@given(PROSE, st.integers(3, 20), st.integers(0, 2))
def test_cut_by_tokens(text, limit, overlap):
    pieces = cut(text, limit, overlap, "tokens")
    assert all(len(TOKEN.findall(text[s:e])) <= limit for s, e, _ in pieces)
    assert "".join(re.sub(r"\s", "", text)) == "" or pieces


def test_split_rows(spark):
    text = "One sentence. " * 400
    rows = [(1, 7, text), (1, 7, text), (2, None, "short"), (3, 8, None), (4, 8, ""), (None, 8, text), (5, 9, "x" * 50_001)]
    out = split_texts(spark.createDataFrame(rows, "id long, paper_id long, text string"), "id", "text", keep=("paper_id",)).toPandas()
    assert sorted(out["id"].unique()) == [1, 2, 5]
    one = out[out.id == 1].sort_values("piece_no")
    assert (one["n_pieces"] == len(one)).all() and (one["cut"] == "natural").all()
    assert all(text[r.start : r.end] == r.piece and len(r.piece) <= 2000 for r in one.itertuples())
    assert (out[out.id == 5]["cut"] == "forced").all()
    assert split_texts(spark.createDataFrame([], "id long, text string"), "id", "text").count() == 0


FAMILY_CASES = (
        ("the pairing <f, g> and n < 5 and m > 3, R&D, a <= b", []),
        ("where f''(0) = 1 and f''(x) of size |S|. item #3, C#2, 3 * 4 * 5, max_degree, [12, 14] [MATH_3] 2 ~ 3", []),
        (r"a formula $\alpha_1 <b> **x**$ and \(\beta\) and \[ \frac{a}{b} \]", []),
        ("(1) one\n(10) ten", []),
        ('<p class="note">x</p>', ["html"]),
        ("a&nbsp;b", ["html"]),
        ("a <!-- b --> c<sup>5</sup>", ["html"]),
        ("<UL><LI>one<LI>two</UL>", ["html"]),
        ("# Heading\n\ntext", ["markdown"]),
        ("so __that__ `code` it", ["markdown"]),
        ("see [the](#sec-1) text", ["markdown"]),
        ("a\n- b\n- c", ["markdown"]),
        ("> quoted", ["markdown"]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]),
        ("```\ncode\n```", ["markdown"]),
        ("a [[b|c]] d", ["wiki"]),
        ("a {{cite|b|3}} c", ["wiki"]),
        ("our '''for''' ''all'' x", ["wiki"]),
        ("== Title ==\ntext", ["wiki"]),
        ("{| class=wikitable\n! a\n|-\n| 16\n|}", ["wiki"]),
        (r"\emph{the} (see~\ref{thm:a})", ["latex"]),
        (r"a \begin{itemize} \item b \end{itemize}", ["latex"]),
        ("a\n[[Category:B]] \\medskip", ["wiki", "latex"]),
)


@pytest.mark.parametrize(("text", "families"), FAMILY_CASES)
def test_families(text, families):
    assert markup.families(text) == families


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("plain $x_1$ text", "plain $x_1$ text"),
        ("<h2>Set of it</h2>\n<div>One &amp; two $x<y$.</div>", "## Set of it\n\nOne & two $x<y$."),
        ("<ul><li>first one here</li><li>second one there</li></ul>", "- first one here\n- second one there"),
        ("so __that__ `code` [our](#s) it", "so that `code` our it"),
        ("== Title ==\na [[b|c]] '''d'''", "## Title\na c d"),
        (r"\section{New} a \emph{b} \begin{itemize} \item c \end{itemize}", "## New\na b\n\n- c"),
    ],
)
def test_clean(text, clean):
    assert markup.clean(text)[1] == clean


def test_content_is_kept_and_code_is_verbatim():
    def clean(text):
        return markup.clean(text)[1]

    assert clean("intro <table><tr><td>1</td><td>2</td></tr></table> short") == "intro\n\n1 | 2\n\nshort"
    assert clean("<pre>if x:\n    y &lt; 1</pre> after") == "```\nif x:\n    y < 1\n```\nafter"
    assert clean("so **b**\n```\ndef f():\n    **kw\n```\nend") == "so b\n```\ndef f():\n    **kw\n```\nend"
    assert clean("\\emph{a}\n\\begin{verbatim}\n  \\foo{x} %\n\\end{verbatim}") == "a\n\n```\n  \\foo{x} %\n```"
    nested = "deep"
    for _ in range(10):
        nested = rf"\emph{{{nested}}}"
    assert clean(f"a {nested} b") == "a deep b"
    assert clean(r"x\footnote{see \textbf{it \emph{now}}} \cite{a{b}c} y {\bf z} and {set}") == "x (see it now) y z and {set}"
    assert clean('<div><a href="/">Home</a> <a>About</a></div> <p>Every bounded map of a closed set has a limit.</p> tail <b>word</b>') == "Every bounded map of a closed set has a limit.\ntail word"
    assert clean(r"\section{A} $x_1$ \verb|\y{z}|") == "## A\n$x_1$ `\\y{z}`"


def test_region_on_held_out_pages():
    score = markup.learn_weights(markup.labelled_pages())
    assert score["word"] > 0 and all(v < 0 for k, v in score.items() if k != "word") and score["html a"] < score["html b"]
    right = total = 0
    for before, content, after in markup.labelled_pages(200, seed=99):
        page = "\n".join((before, content, after))
        bare = markup.hold(page)[0]
        tags = markup.scan(bare)
        lo, hi = markup.content_region(bare, tags)
        start, end = len(before), len(before) + 2 + len(content)
        for s, e, kind in markup.pieces(bare, tags):
            if kind == "word":
                total += 1
                right += (lo <= s and e <= hi) == (start <= s and e <= end)
    assert right / total > 0.97


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["one ", "two", "<b>", "</b>", "<td>", "<table>", "**", "__", "}", "\\emph{", "''", "\n", "- ", "# ", "{|", "`", "$a$", "&amp;", "== "]), max_size=30))
def test_clean_loses_no_words(parts):
    text = "".join(parts)
    found, out = markup.clean(text)
    assert (out == text) if not found else len(re.findall("one|two", out)) == len(re.findall("one|two", text)), (text, out)


def test_suspects_cover_all_families(spark):
    held = [t for t, f in FAMILY_CASES if f]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(held)], "id long, t string")
    got = {r.id: list(r.families) for r in markup.clean_texts(rows, ("id",), "t").collect()}
    assert got == {i: markup.families(t) for i, t in enumerate(held)} and all(got.values())
    assert {r.id: list(r.families) for r in markup.clean_texts(rows, ("id",), "t", False).collect()} == got


def test_clean_rows(spark):
    rows = [(1, "<b>x</b> " * 30_000), (2, None), (None, "plain"), (3, "")]
    out = {r.id: r for r in markup.clean_texts(spark.createDataFrame(rows, "id long, t string"), ("id",), "t").collect()}
    assert set(out) == {1, None, 3} and out[1].families == ["html"] and out[3].clean_text == "" and out[1].tokens == ["x"] * 30_000


def shares(text, run=5):
    w = re.findall(r"[^\W_]+", text.lower())
    seen, covered = set(), set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        covered.update(range(i, i + run)) if g in seen else seen.add(g)
    return len(w), len(covered)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "b", "é", "x1", "--", "c_d"]), max_size=40), max_size=6))
def test_repetition_equals_brute_force(docs):
    texts = [" ".join(d) for d in docs]
    codes, offsets, _ = rep.word_codes(pa.array(texts, pa.string()))
    flags = np.concatenate([[0], np.cumsum(rep.repeated_positions(codes, offsets))])
    assert list(zip(np.diff(offsets), np.diff(flags[offsets]))) == [shares(t) for t in texts]


def test_repetition_rows(spark):
    rows = [(1, "a b c d e " * 20_000), (2, None), (3, ""), (None, "one two"), (4, "a b c d e f"), (4, "a b c d e f")]
    out = rep.graded(spark.createDataFrame(rows, "id long, t string"), "id", "t").toPandas().sort_values(["id", "words"])
    assert out["share"].round(4).tolist() == [1.0, 0.0, 0.0, 0.0, 0.0, 0.0] and len(out) == 6


def quality_texts(seed, n):
    """Documents over a common vocabulary, a third of which say one or two sentences again and again between others."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"w{x}" for x in np.minimum(rng.zipf(1.3, 160), 900)]
        if i % 3 == 0:
            line = words[: int(rng.integers(8, 25))]
            for _ in range(int(rng.integers(2, 9))):
                at = int(rng.integers(len(words)))
                words[at:at] = line
        out.append(" ".join(words))
    return out


def test_quality_model_on_held_out_documents():
    texts, other = quality_texts(0, 900), quality_texts(1, 400)
    label = lambda t: np.array([b >= 0.3 * a for a, b in map(shares, t)])
    model = rep.QualityModel.fit(pa.array(texts), label(texts))
    p = np.concatenate([model.probability(pa.array(other[i : i + 100])) for i in range(0, 400, 100)])
    want = label(other)
    assert ((p >= 0.5) == want).mean() > 0.9 and abs(p.mean() - want.mean()) < 0.05
    edge = model.probability(pa.array(["", None], pa.string()))
    assert np.isfinite(edge).all() and (edge < 0.5).all()
    assert rep.QualityModel.fit(pa.array([], pa.string()), np.array([])).probability(pa.array(["a"]))[0] < 0.01


def test_slices_cover_all_texts(monkeypatch):
    monkeypatch.setattr(rep, "SLICE_CHARS", 10)
    texts = pa.array(["abc", None, "x" * 50, "", "defg", "hij", "k" * 4] + ["a"] * 600)
    cuts = list(rep._slices(texts))
    assert [a for a, _ in cuts] == [0, *np.cumsum([n for _, n in cuts])[:-1]] and sum(n for _, n in cuts) == len(texts)
    assert all(n == 1 or sum(len(t or "") for t in texts.slice(a, n).to_pylist()) <= 10 for a, n in cuts) and max(n for _, n in cuts) <= 256
    assert list(rep._slices(pa.array([], pa.string()))) == []


def test_graded_rows(spark):
    rows = list(enumerate(quality_texts(2, 300))) + [(None, "x"), (5, "again"), (1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "id long, t string").selectExpr("*", "1 as words", "2 as probability", "3 as band")
    model = rep.fit_quality(docs, "id", "t", train_rows=100)
    again = rep.fit_quality(docs.repartition(7), "id", "t", train_rows=100)
    assert (model.weights == again.weights).all() and model.offset == again.offset
    out = rep.graded(docs, "id", "t", model).toPandas()
    assert len(out) == len(rows) and out["probability"].between(0, 1).all() and set(out["band"]) <= {"clean", "doubtful", "repetitive"}
    empty = docs.where("false")
    assert rep.graded(empty, "id", "t", rep.fit_quality(empty, "id", "t")).count() == 0


def test_marks_left_open_take_one_pass():
    for mark in ("<a>", "<nav>", "<pre>", "<code>", "<script>", "\\begin{verbatim}"):
        began = time.process_time()
        out = markup.clean(f"{mark}x " * 20_000)[1]
        assert len(re.findall(r"\bx\b", out)) == 20_000 and time.process_time() - began < 5, mark
    assert markup.clean("<b>a</b> <pre>p <code>c</code> z")[1] == "a p `c` z"


def test_p3_found_takes_the_whole_operator_on_one_text_a_chunk(spark, tmp_path):
    rows = [(1, " Paragraph", "<b>x</b>"), (1, "paragraph", "**x** y"), (2, "paragraph", r"\emph{a} [[b|c]]"), (2, "paragraph", r"\emph{a} [[b|c]]")]
    rows += [(3, "equation", "<b>x</b>"), (4, "paragraph", None), (None, "paragraph", "<b>x</b>"), (5, "paragraph", "plain"), (6, "paragraph", "<br>")]
    spark.createDataFrame(rows, "id long, kind string, text string").write.parquet(f"{tmp_path}/chunk.parquet")
    found = queries.p3_found(spark, str(tmp_path))
    assert sorted((r.chunk_id, r.family) for r in found.collect()) == [(1, "markdown"), (2, "latex"), (2, "wiki"), (6, "html")]
    assert "clean_text" in found._jdf.queryExecution().optimizedPlan().toString(), "the region and the clean form come before the families"
