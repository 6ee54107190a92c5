"""Text and LaTeX functions as column expressions.

Null in gives null out unless a function says otherwise. None is a Python UDF,
so all of them stay in the JVM and fold into the surrounding plan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import hints

MATH = r"\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)|\$\$[\s\S]*?\$\$|\$[\s\S]*?\$"
_NOT_WORD = r"[^0-9A-Za-z_\u00C0-\u024F\u0370-\u03FF\u0400-\u04FF]+"
_DIGIT = r"\p{Nd}\u00B2\u00B3\u00B9\u2070\u2074-\u2079\u2080-\u2089"
_MATH_TOKEN = rf"\\\p{{L}}+|\\[\s\S]?|[\^_{{}}\[\]()=+\-*/:,.;<>|!]|[{_DIGIT}][{_DIGIT}.]*|\p{{L}}[\p{{L}}\p{{N}}']*"
_LINE_ENDS = r"\r\n|[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def _empty() -> Column:
    return F.array().cast("array<string>")


def one_line_ends(s: Column) -> Column:
    """Every kind of line end as a line feed, without one at the end of the text."""
    return F.regexp_replace(F.regexp_replace(s, _LINE_ENDS, "\n"), r"\n\z", "")


def strip_comments(tex: Column) -> Column:
    """LaTeX without comments: a line ends before its first percent sign that has no backslash before it."""
    return F.regexp_replace(one_line_ends(tex), r"(?<!\\)%[^\n]*", "")


def strip_comments_lenient(tex: Column) -> Column:
    """As strip_comments, but a line whose first percent sign is escaped stays whole."""
    return F.regexp_replace(one_line_ends(tex), r"(?m)^((?:[^%\n]*[^%\\\n])?)%[^\n]*", "$1")


def math_segments(s: Column) -> Column:
    """Inline and display formulas with their delimiters, in order."""
    return F.regexp_extract_all(s, F.lit(f"({MATH})"), 1)


def without_math(s: Column) -> Column:
    """s with each formula replaced by a blank placeholder [MATH]."""
    return F.regexp_replace(s, MATH, " [MATH] ")


def drop_placeholders(s: Column) -> Column:
    return F.regexp_replace(s, r"\[MATH_\d+\]", " ")


def strip_delimiters(s: Column) -> Column:
    """A formula without the pair of delimiters around it; a lone dollar sign is a pair with itself and leaves nothing."""

    def cut(n: int) -> Column:
        return F.substring(s, F.lit(n + 1), F.greatest(F.lit(0), F.length(s) - 2 * n))

    return (
        F.when(s.startswith("$$") & s.endswith("$$"), cut(2))
        .when(s.startswith("$") & s.endswith("$"), cut(1))
        .when(s.startswith("\\[") & s.endswith("\\]"), cut(2))
        .when(s.startswith("\\(") & s.endswith("\\)"), cut(2))
        .otherwise(s)
    )


# Commands whose argument is dropped with them.
_DROPPED = (
    "cite citep citet ref eqref label footnote url includegraphics thanks footnotemark footnotetext bibliography "
    "bibliographystyle usepackage documentclass newcommand renewcommand DeclareMathOperator input include tableofcontents"
).split()


def latex_to_text(tex: Column, drop_latex_args: bool = False) -> Column:
    """Prose of LaTeX: command names and braces dropped, arguments kept, white space collapsed.

    With drop_latex_args the arguments of citations, references, labels and the
    like go too.
    """
    s = tex
    if drop_latex_args:
        s = F.regexp_replace(s, rf"\\(?:{'|'.join(_DROPPED)})\s*\*?\s*\{{[^}}]*\}}", " ")
    s = F.regexp_replace(s, r"\\[A-Za-z@]+", " ")
    s = F.regexp_replace(s, r"[{}]", " ")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def text_tokens(s: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores as the index has them; an empty array for null."""
    plain = F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), _NOT_WORD, " ")
    return F.filter(F.split(plain, " "), lambda t: t != "")


def singular(token: Column) -> Column:
    """The singular form by ending: short words stay, ies to y, then es after a sibilant, then s."""
    t = F.lower(token)
    n = F.length(t)

    def drop(k: int) -> Column:
        return F.substring(t, F.lit(1), n - k)

    return (
        F.when(n < 4, t)
        .when(t.endswith("ies") & (n > 4), F.concat(drop(3), F.lit("y")))
        .when(t.rlike("(?:sses|zzes)$"), drop(2))
        .when(t.rlike("(?:s|x|z|ch|sh)es$"), drop(2))
        .when(t.rlike("(?<!s)s$"), drop(1))
        .otherwise(t)
    )


def query_text_tokens(s: Column) -> Column:
    """text_tokens of a query: the Unicode minus counts as a hyphen, and every token is made singular."""
    return F.transform(text_tokens(F.regexp_replace(s, "\u2212", "-")), singular)


def math_tokens(formula: Column) -> Column:
    """Tokens of a formula: commands, escaped characters, symbols, numbers and identifiers; an empty array for null."""
    s = strip_delimiters(F.coalesce(formula, F.lit("")))
    s = F.regexp_replace(s, r"\\(?:begin|end)\{[^}]+\}", " ")
    return F.transform(F.regexp_extract_all(s, F.lit(f"({_MATH_TOKEN})"), 1), F.lower)


def _command(name: str, doubled: bool) -> str:
    return "\\" + name if doubled and name.startswith("\\") else name


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def expand(tokens: Column, raw: Column | None, query: bool, math_hint_compat: bool = False) -> Column:
    """tokens without placeholders, command variants unified, then the sorted distinct extras.

    Extras are singular forms, and commands hinted at by words, by pairs of
    neighbouring tokens, and by phrases of the raw text (and, in a query, its
    raw operators). An extra that is already a token comes once more. With
    math_hint_compat hints carry two backslashes and variants stay as they are.
    """
    kept = F.filter(tokens, lambda t: ~t.rlike(r"^math_\d+$"))
    if not math_hint_compat:
        variants = _lookup(hints.VARIANTS)
        kept = F.transform(kept, lambda t: F.coalesce(F.element_at(variants, t), t))
    words = _lookup({k: _command(v, math_hint_compat) for k, v in hints.WORD_HINTS.items()})
    singulars = F.filter(F.transform(kept, lambda t: F.when(~t.startswith("\\") & (singular(t) != t), singular(t))), lambda t: t.isNotNull() & (t != ""))
    hinted = F.filter(F.transform(kept, lambda t: F.element_at(words, t)), lambda t: t.isNotNull())
    bridges = hints.BRIDGES if query else hints.BRIDGES[:7]
    following = F.slice(kept, F.lit(2), F.greatest(F.lit(0), F.size(kept) - 1))
    pairs = F.zip_with(kept, following, lambda a, b: F.concat(a, F.lit("\x00"), b))
    bridge = _lookup({f"{a}\x00{b}": _command(c, math_hint_compat) for a, b, c in bridges})
    bridged = F.filter(F.transform(F.filter(pairs, lambda p: p.isNotNull()), lambda p: F.element_at(bridge, p)), lambda t: t.isNotNull())
    extras = F.concat(singulars, hinted, bridged)
    if raw is not None:
        low = F.lower(F.coalesce(raw, F.lit("")))
        found = [F.when(F.contains(low, F.lit(p)), F.lit(_command(c, math_hint_compat))) for p, c in hints.PHRASES + (hints.RAW_OPERATORS if query else ())]
        extras = F.concat(extras, F.filter(F.array(*found), lambda t: t.isNotNull()))
    return F.concat(kept, F.array_sort(F.array_distinct(extras)))


def symbol_commands(q: Column, math_hint_compat: bool = False) -> Column:
    """Commands that the symbols, Greek and blackboard letters of q stand for, each once, in order of appearance."""
    table = {k: [_command(c, math_hint_compat) for c in v] for k, v in (hints.SYMBOL_HINTS | hints.GREEK_HINTS).items()}
    entries = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]
    lookup = F.create_map(*entries)
    symbols = "".join(table)
    present = F.regexp_extract_all(q, F.lit(f"([{symbols}])"), 1)
    return F.array_distinct(F.flatten(F.transform(present, lambda c: F.element_at(lookup, c))))


def query_tokens(q: Column, math_hint_compat: bool = False) -> Column:
    """All tokens of a query: of the whole text, of its formulas and of its symbols, expanded; an empty array for null."""
    q = F.coalesce(q, F.lit(""))
    formulas = F.flatten(F.transform(math_segments(q), math_tokens))
    return expand(F.concat(query_text_tokens(q), formulas, symbol_commands(q, math_hint_compat)), q, True, math_hint_compat)


def chunk_tokens(text: Column, kind: Column, math_hint_compat: bool = False) -> Column:
    """Index tokens of a chunk: math tokens of an equation, else prose tokens, expanded."""
    prose = expand(text_tokens(text), text, False, math_hint_compat)
    formula = expand(math_tokens(text), None, False, math_hint_compat)
    return F.when(clean_kind(kind) == "equation", formula).otherwise(prose)


def tokenize_stages(q: Column, math_hint_compat: bool = False) -> Column:
    """The stages of query tokenizing as a struct: text_tokens, math_segments, math_tokens, final."""
    q = F.coalesce(q, F.lit(""))
    return F.struct(
        query_text_tokens(q).alias("text_tokens"),
        math_segments(q).alias("math_segments"),
        F.flatten(F.transform(math_segments(q), math_tokens)).alias("math_tokens"),
        query_tokens(q, math_hint_compat).alias("final"),
    )


def paragraphs(tex: Column) -> Column:
    """Paragraphs between blank lines, trimmed, none empty."""
    parts = F.transform(F.split(tex, r"\n(?U)\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def clean_kind(kind: Column) -> Column:
    """A chunk kind without the spaces and the case it comes with."""
    return F.lower(F.trim(kind))


def base_id(paper_id: Column, by_last_v: bool = False) -> Column:
    """A paper id without its version: the digits after a final v, or with by_last_v all from the last v of any kind."""
    if by_last_v:
        return F.regexp_replace(paper_id, r"v[^v]*$", "")
    return F.regexp_replace(paper_id, r"v\d+$", "")


def normal_id(paper_id: Column) -> Column:
    """A trimmed paper id without version, an old one with a slash: math_0404297 as math/0404297."""
    s = F.trim(paper_id)
    s = F.when(s.rlike(r"v\d+$"), F.element_at(F.split(s, "v"), 1)).otherwise(s)
    return F.regexp_replace(s, r"^([A-Za-z\-]+)_(\d{7})$", "$1/$2")


def paper_url(paper_id: Column, form: str = "abs") -> Column:
    """Address of a paper's page (abs) or file (pdf)."""
    path = F.regexp_replace(paper_id, r"^([A-Za-z\-]+)_(\d{7})(?:v\d+)?$", "$1/$2")
    return F.concat(F.lit(f"https://arxiv.org/{form}/"), path, F.lit(".pdf" if form == "pdf" else ""))


def preview(text: Column, chars: int = 400) -> Column:
    """The head of a text with white space collapsed; empty for null."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), 1, chars)


def abstract_preview(text: Column, chars: int = 500) -> Column:
    s = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(s) > chars, F.concat(F.substring(s, 1, chars), F.lit("…"))).otherwise(s)


def authors_line(authors: Column, shown: int = 4) -> Column:
    """The first authors and how many more there are; empty for null."""
    names = F.coalesce(authors, _empty())
    more = F.when(F.size(names) > shown, F.concat(F.lit(" +"), (F.size(names) - shown).cast("string"))).otherwise("")
    return F.concat(F.array_join(F.slice(names, 1, shown), ", "), more)
