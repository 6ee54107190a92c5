import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def many(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r["r"] for r in rows.select("i", f(F.col("t")).alias("r")).orderBy("i").collect()]


def test_singular(spark):
    words = ["theories", "classes", "boxes", "phases", "analysis", "gas", "dies", "glass", "ties", "buzzes", "matches", "dishes", "Cats", "", None, "s", "ss", "cases"]
    want = ["theory", "class", "box", "phas", "analysi", "gas", "die", "glass", "tie", "buzz", "match", "dish", "cat", "", None, "s", "ss", "cas"]
    assert many(spark, words, T.singular) == want


def test_math_tokens(spark):
    formulas = [
        r"$\alpha_1 + x^2$", r"\[ \Sum_{i=1}^{n} f'(x) \]", r"$\|x\| \leq 3.14$", r"\begin{align*} a\\ b \end{align*}", "$$x$$", "$", "", None, "\\(é1'\\)", "\\",
    ]
    want = [
        ["\\alpha", "_", "1", "+", "x", "^", "2"],
        ["\\sum", "_", "{", "i", "=", "1", "}", "^", "{", "n", "}", "f'", "(", "x", ")"],
        ["\\|", "x", "\\|", "\\leq", "3.14"],
        ["a", "\\\\", "b"], ["x"], [], [], [], ["é1'"], ["\\"],
    ]
    assert many(spark, formulas, T.math_tokens) == want


def test_strip_comments(spark):
    tex = "a % b\n\\% kept % gone\r\n% all\nend\\%"
    assert one(spark, tex, T.strip_comments) == "a \n\\% kept \n\nend\\%"
    assert one(spark, tex, T.strip_comments_lenient) == "a \n\\% kept % gone\n\nend\\%"
    assert one(spark, None, T.strip_comments) is None


def test_latex_to_text(spark):
    tex = "See \\cite{foo} and \\emph{this  thing}\n{x}"
    assert one(spark, tex, T.latex_to_text) == "See foo and this thing x"
    assert one(spark, tex, lambda c: T.latex_to_text(c, True)) == "See and this thing x"


@pytest.mark.parametrize(
    ("q", "tokens"),
    [
        ("phases", ["phas", "pha"]),
        ("for all α ≤ β", ["for", "all", "α", "β", "\\alpha", "\\leq", "\\beta", "\\forall"]),
        ("the integral $a <= b$", ["the", "integral", "a", "b", "a", "<", "=", "b", "\\int", "\\leq"]),
        ("ℝ ‖", ["\\mathbb", "r", "\\Vert", "\\|"]),
        ("[MATH_3] $\\varepsilon$", ["varepsilon", "\\epsilon"]),
        ("", []),
        (None, []),
    ],
)
def test_query_tokens(spark, q, tokens):
    assert one(spark, q, T.query_tokens) == tokens


def test_compatible_hints(spark):
    assert one(spark, "integral $\\varphi$", lambda c: T.query_tokens(c, True)) == ["integral", "varphi", "\\varphi", "\\\\int"]


def test_chunk_tokens(spark):
    rows = spark.createDataFrame([("Classes of sums", " Paragraph"), ("$a -> b$", "equation "), ("x", None), (None, "equation")], "t string, k string")
    got = [r[0] for r in rows.select(T.chunk_tokens(F.col("t"), F.col("k"))).collect()]
    assert got == [["classes", "of", "sums", "class", "sum"], ["a", "-", ">", "b", "\\to"], ["x"], []]


def test_ids(spark):
    ids = ["math_0404297", "1012.1190v2", "solv-int_9701001", " hep-th/9901001v1 ", None]
    assert many(spark, ids, T.normal_id) == ["math/0404297", "1012.1190", "solv-int/9701001", "hep-th/9901001", None]
    assert many(spark, ids[:3], T.base_id) == ["math_0404297", "1012.1190", "solv-int_9701001"]
    assert many(spark, ids[:3], lambda c: T.base_id(c, True)) == ["math_0404297", "1012.1190", "sol"]
    assert many(spark, ["math_0404297v1", "1012.1190"], lambda c: T.paper_url(c, "pdf")) == ["https://arxiv.org/pdf/math/0404297.pdf", "https://arxiv.org/pdf/1012.1190.pdf"]


def test_paragraphs_and_previews(spark):
    assert one(spark, " a\n \n\n b \n\n", T.paragraphs) == ["a", "b"]
    assert one(spark, "x \n y" * 300, T.preview) == ("x y" * 300)[:400]
    assert len(one(spark, "y" * 501, T.abstract_preview)) == 501
    rows = spark.createDataFrame([(["a", "b", "c", "d", "e", "f"],), (None,)], "a array<string>")
    assert [r[0] for r in rows.select(T.authors_line(F.col("a"))).collect()] == ["a, b, c, d +2", ""]
