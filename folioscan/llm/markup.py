"""Markup residue in texts: which families a text holds, and its clean form."""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAMILIES = ("html", "markdown", "wiki", "latex")

# Element names of HTML.
_ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base bdi bdo big blink blockquote body br button canvas caption center cite "
    "code col colgroup data dd del details dfn dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 "
    "h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta nav nobr noscript object ol "
    "optgroup option output p param picture pre q rp rt ruby s samp script section select small source span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()

_ATTR = r"""(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?)*"""
_TAG = rf"</?(?:{'|'.join(_ELEMENTS)}){_ATTR}\s*/?>"
_COMMENT = r"<!--.*?-->"
_REF = r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});"

#: Formulas and placeholders; never markup, and kept as they are.
FORMULA_PATTERN = r"\$\$[\s\S]*?\$\$|\$[^$]*\$|\\\([\s\S]*?\\\)|\\\[[\s\S]*?\\\]|\[MATH_\d+\]"
FORMULA = re.compile(FORMULA_PATTERN)
#: What stands for the part of number n that is put aside.
_HELD = re.compile("\ue000(\\d+)\ue001")
#: A text without any of these, formulas aside, holds no markup.
SUSPECT = r"[<&#*`\[>|{\\]|__|''|(?:^|\n)[ \t]*[-+=]|(?:^|\n)[ \t]*~~~|:?-{3,}"

_HTML = re.compile(rf"{_TAG}|{_COMMENT}|{_REF}", re.I | re.S)
_MD = re.compile(
    r"^ {0,3}#{1,6}[ \t]+\S"
    r"|\*\*(?=[^\s*])[^*]*?(?<=[^\s*])\*\*|(?<!\w)__(?=[^\s_])[^\n]*?(?<=[^\s_])__(?!\w)"
    r"|^ {0,3}(?:```|~~~)|`[^`\n]+`"
    r"|(?<!\[)!?\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"]*\")?\)"
    r"|^ {0,3}[-+][ \t]+\S"
    r"|^ {0,3}>[ \t]*[^\s\d=]"
    r"|^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*:?-*:?[ \t]*\|?[ \t]*$",
    re.M,
)
_WIKI = re.compile(
    r"\[\[[^\[\]\n]+\]\]"
    r"|\{\{[ \t]*[A-Za-z#!:][^{}]*\}\}"
    r"|(?<![\w')\]])('{2,5})(?=[^\s'])[^\n]*?(?<=[^\s'])\1(?![\w'])"
    r"|^(={1,6})[ \t]*[^\s=][^\n]*?[ \t]*\2[ \t]*$"
    r"|^[ \t]*\{\|",
    re.M,
)
_LATEX = re.compile(r"\\(?:begin|end)\s*\{|\\[A-Za-z@]+")


class Held:
    """Parts of a text that are put aside and come back as they were."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def put(self, part: str) -> str:
        self.parts.append(part)
        return f"\ue000{len(self.parts) - 1}\ue001"

    def back(self, text: str) -> str:
        while _HELD.search(text):
            text = _HELD.sub(lambda m: self.parts[int(m[1])], text)
        return text


def hold(text: str) -> tuple[str, Held]:
    """text with every formula and placeholder put aside, and those."""
    held = Held()
    plain = text.replace("\ue000", " ").replace("\ue001", " ")
    return FORMULA.sub(lambda m: held.put(m[0]), plain), held


_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)")
# Commands and wiki names that stand around a text and not in it.
_AROUND = "documentclass usepackage newcommand renewcommand bibliography bibliographystyle maketitle tableofcontents pagestyle author date input include".split()
_CATEGORY = re.compile(r"\[\[(?:Category|File|Image|Kategorie|Catégorie|Categoría):", re.I)


def _kind(family: str, tag: str) -> str:
    """The kind of a tag, for its weight."""
    if family == "html":
        name = _NAME.match(tag)
        return f"html {name[1].lower()}" if name else "html reference" if tag[0] == "&" else "html comment"
    if family == "wiki":
        return "wiki category" if _CATEGORY.match(tag) else "wiki template" if tag.startswith("{{") else "wiki link" if tag.startswith("[[") else "wiki mark"
    if family == "latex":
        return "latex around" if tag.lstrip("\\").rstrip("{ ") in _AROUND else "latex mark"
    return "markdown link" if "](" in tag else "markdown mark"


def scan(bare: str) -> list[tuple[int, int, str, str]]:
    """The tags of all families in a text whose formulas are held, (start, end, family, kind), by place."""
    tests = zip(FAMILIES, (_HTML, _MD, _WIKI, _LATEX))
    return sorted((m.start(), m.end(), name, _kind(name, m[0])) for name, test in tests for m in test.finditer(bare))


def families(text: str) -> list[str]:
    """The families of the tags that the scan finds, in the order of FAMILIES."""
    seen = {tag[2] for tag in scan(hold(text)[0])}
    return [name for name in FAMILIES if name in seen]


# Words of the generated pages: of running text and of what stands around it.
_TEXT = "let every bounded map of a closed set into the plane have limit proof is short and uses only norm suppose that function open then each point series converges to identity we show estimate holds for all values parameter group acts on tree without fixed points".split()
_MENU = "home about help next back list contact login archive search top print share terms privacy index".split()


_I, _B = "'" * 2, "'" * 3


def labelled_pages(count: int = 300, seed: int = 3) -> list[tuple[str, str, str]]:
    """Pages (before, content, after) of all families, made by rule: menus, forms, preambles and categories around headings, prose, lists, tables, code and formulas."""
    rng = random.Random(seed)

    def some(words: list[str], low: int, high: int) -> list[str]:
        return [rng.choice(words) for _ in range(rng.randint(low, high))]

    def prose(family: str) -> str:
        words = some(_TEXT, 15, 50)
        at = rng.randrange(len(words))
        inline = {"html": ["<b>{}</b>", "<i>{}</i>", "<sup>{}</sup>", '<a href="#s">{}</a>'], "markdown": ["**{}**", "__{}__", "`{}`", "[{}](#s)"], "wiki": [_B + "{}" + _B, _I + "{}" + _I, "[[{}]]"], "latex": [r"\emph{{{}}}", r"\textbf{{{}}}", r"\ref{{{}}}"]}
        words[at] = rng.choice(inline[family]).format(words[at])
        line = " ".join(words) + "."
        return f"<p>{line}</p>" if family == "html" and rng.random() < 0.7 else line

    def block(family: str) -> str:
        words = [" ".join(some(_TEXT, 2, 6)) for _ in range(4)]
        forms = {
            "html": ["<h2>{0}</h2>", "<ul><li>{0}</li><li>{1}</li></ul>", "<table><tr><td>{0}</td><td>{1}</td></tr><tr><td>{2}</td><td>{3}</td></tr></table>", "<pre>{0}\n  {1}</pre>", "<div>{0} &amp; {1}</div>"],
            "markdown": ["## {0}", "- {0}\n- {1}", "| {0} | {1} |\n|---|---|\n| {2} | {3} |", "```\n{0}\n  {1}\n```", "> {0}"],
            "wiki": ["== {0} ==", "* {0}\n* {1}", "{{|\n| {0} || {1}\n|-\n| {2} || {3}\n|}}"],
            "latex": [r"\section{{{0}}}", r"\begin{{itemize}} \item {0} \item {1} \end{{itemize}}", r"\begin{{verbatim}}{0}\end{{verbatim}}"],
        }
        return rng.choice(forms[family]).format(*words)

    def around(family: str) -> str:
        names = some(_MENU, 2, 7)
        forms = {
            "html": ["<div>" + " ".join(f'<a href="/{n}">{n}</a>' for n in names) + "</div>", "<ul>" + "".join(f"<li><a>{n}</a></li>" for n in names) + "</ul>", "<form><input/><button>{}</button></form>".format(names[0]), "<nav>" + "".join(f"<a>{n}</a>" for n in names) + "</nav>", "<p><img/><br/><img/></p>"],
            "markdown": [" ".join(f"[{n}](/{n})" for n in names), "- " + "\n- ".join(f"[{n}](/{n})" for n in names)],
            "wiki": ["\n".join(f"[[Category:{n}]]" for n in names), "{{navbox|" + "|".join(names) + "}}"],
            "latex": [r"\documentclass{" + names[0] + "}\n" + "\n".join(rf"\usepackage{{{n}}}" for n in names), r"\bibliographystyle{" + names[0] + "}\n" + r"\bibliography{" + names[0] + "}"],
        }
        return rng.choice(forms[family])

    pages = []
    for i in range(count):
        family = FAMILIES[i % len(FAMILIES)]
        content = "\n".join(prose(family) if rng.random() < 0.6 else block(family) for _ in range(rng.randint(2, 6)))
        sides = ["\n".join(around(family) for _ in range(rng.randint(0, 3))) for _ in range(2)]
        pages.append((sides[0], content + "\n" + prose(family), sides[1]))
    return pages


_WORD = re.compile("\\w+")


def pieces(bare: str, tags: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Tags, words, words of links and held parts in order, (start, end, kind); what a tag covers is none of its own but for a link's words."""
    out, at, open_links = [], 0, 0
    for start, end, family, kind in [*tags, (len(bare), len(bare), "", "")]:
        if start > at:
            name = "linked" if open_links else "word"
            out += [(m.start(), m.end(), name) for m in _WORD.finditer(bare, at, start)]
        if not family:
            break
        out.append((start, end, kind))
        if kind == "html a":
            open_links = 0 if bare.startswith("</", start) else 1
        inner = re.search(r"\[([^\[\]]*)\]|''+([^']+)|\*\*([^*]+)|__([^_]+)", bare[start:end]) if family in ("wiki", "markdown") else None
        if inner and start >= at:
            name = "linked" if kind in ("markdown link", "wiki category") else "word"
            out += [(start + m.start(), start + m.end(), name) for m in _WORD.finditer(bare[start:end], inner.start(), inner.end())]
        at = max(at, end)
    return out


def learn_weights(pages: list[tuple[str, str, str]]) -> dict[str, float]:
    """The score of each kind of piece, above 0 for words and below for tags: its log odds of being content on the labelled pages, smoothed."""
    count: dict[str, list[float]] = {}
    for page in pages:
        for i, part in enumerate(page):
            bare = hold(part)[0]
            for _, _, kind in pieces(bare, scan(bare)):
                count.setdefault(kind, [1.0, 1.0])[i == 1] += 1
    odds = {kind: math.log(inside / outside) for kind, (outside, inside) in count.items()}
    return {k: max(v, 0.1) if k == "word" else min(v, -0.05) for k, v in odds.items()}


@lru_cache(1)
def weights() -> dict[str, float]:
    return learn_weights(labelled_pages())


def content_region(bare: str, tags: list[tuple[int, int, str, str]], score: dict[str, float] | None = None) -> tuple[int, int]:
    """Offsets of the contiguous region of greatest score; all of a text without tags.

    One linear scan; of equal regions the first and longest counts. A kind of
    tag that the labelled pages lack scores as the mildest.
    """
    if not tags:
        return 0, len(bare)
    score = score or weights()
    best, lo, hi, total, start = 0.0, 0, 0, 0.0, None
    for s, e, kind in pieces(bare, tags):
        if start is None or total < 0:
            total, start = 0.0, s
        total += score.get(kind, -0.05)
        if total > best or total == best and start == lo:
            best, lo, hi = total, start, max(hi, e) if start == lo else e
    return lo, hi


# Elements and wiki parts that are no text where they stand around the region, and those that are none anywhere.
_MENUS = re.compile(r"<(a|nav|form|button|select|noscript)\b[^>]*>", re.I)
_NEVER = re.compile(r"<(script|style)\b[^>]*>", re.I)
_PRE, _CODE = (re.compile(rf"<({name})\b[^>]*>", re.I) for name in ("pre", "code"))
_MENU_LINK = re.compile(r"^[ \t]*(?:[-+*|][ \t]*)?(?:!?\[[^\[\]\n]+\]\([^()\s]+\)[ \t|·,]*)+$", re.M)


def _replaced(s: str, opening: re.Pattern, put: Callable[[str], str], closing: str = r"</{}\s*>") -> str:
    """s with put(inner) for every part from an opening, whose first group is its name, to the next closing of that name.

    A name that has no closing any more is not looked for again, so many that are left open take no more than a pass.
    """
    out, at, pos, lost = [], 0, 0, set()
    while m := opening.search(s, pos):
        name = m[1].lower()
        end = None if name in lost else re.compile(closing.format(name), opening.flags & re.I).search(s, m.end())
        if end is None:
            lost.add(name)
            pos = m.start() + 1
        else:
            out += [s[at : m.start()], put(s[m.end() : end.start()])]
            at = pos = end.end()
    return "".join([*out, s[at:]])


def without_menus(bare: str, region: tuple[int, int]) -> str:
    """bare without links, menus and forms before and after the region. All other words stay, wherever they stand."""

    def bared(part: str) -> str:
        return _MENU_LINK.sub("", _replaced(part, _MENUS, lambda _: " "))

    lo, hi = region
    # A tag that the border cuts in two belongs to the region.
    lo = bare.rfind("<", 0, lo) if "<" in bare[:lo] and ">" not in bare[bare.rfind("<", 0, lo) : lo] else lo
    return bared(bare[:lo]) + bare[lo:hi] + bared(bare[hi:])


_BLOCK = re.compile(r"<(/?)(h[1-6]|p|div|ul|ol|li|tr|td|th|table|br|hr|blockquote|section|article|dt|dd)\b[^>]*>", re.I)


def _from_html(s: str, held: Held) -> str:
    s = _replaced(re.sub(_COMMENT, " ", s, flags=re.S), _NEVER, lambda _: " ")

    def bare(code: str) -> str:
        return html.unescape(re.sub(_TAG, "", code, flags=re.I | re.S))

    s = _replaced(s, _PRE, lambda code: "\n" + held.put("```\n" + bare(code).strip("\n") + "\n```") + "\n")
    s = _replaced(s, _CODE, lambda code: held.put("`" + bare(code) + "`"))
    first = True

    def block(m: re.Match) -> str:
        nonlocal first
        close, name = m[1], m[2].lower()
        if name[0] == "h" and name[1:].isdigit():
            return "\n" if close else "\n" + "#" * int(name[1:]) + " "
        if name == "li":
            return "" if close else "\n- "
        if name in ("td", "th"):
            between = "" if close or first else " | "
            first = first and bool(close)
            return between
        first = name == "tr" or first
        return "\n"

    s = _BLOCK.sub(block, s)
    s = re.sub(_TAG, "", s, flags=re.I | re.S)
    return re.sub(_REF, lambda m: html.unescape(m[0]), s)


_CELL_STYLE = re.compile(r"""(?<!\S)[\w-]+=(?:"[^"]*"|'[^']*'|[^\s="']+)""")


def _from_wiki(s: str) -> str:
    s = re.sub(rf"{_CATEGORY.pattern}[^\[\]\n]*\]\]", "", s, flags=re.I)
    s = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", s)
    s = re.sub(r"\{\{[ \t]*[A-Za-z#!:][^{}]*\}\}", " ", s)
    s = re.sub(r"(?<![\w')\]])('{2,5})(?=[^\s'])([^\n]*?)(?<=[^\s'])\1(?![\w'])", r"\2", s)
    s = re.sub(r"(?m)^(={1,6})[ \t]*([^\s=][^\n]*?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), s)
    out, table = [], False
    for line in s.split("\n"):
        bare = line.strip()
        if bare.startswith("{|"):
            table = True
            out += [x for x in [_CELL_STYLE.sub("", bare[2:]).strip()] if x]
        elif table and bare.startswith("|}"):
            table = False
            rest = bare[2:].strip()
            out += [rest] if rest else []
        elif table and bare.startswith("|-"):
            out += [x for x in [_CELL_STYLE.sub("", bare.lstrip("|-")).strip()] if x]
        elif table and bare[:1] in "|!" and bare:
            out.append(" | ".join(x.strip() for x in re.split(r"\|\||!!", bare[1:])))
        else:
            out.append(line)
    return "\n".join(out)


_FENCE = re.compile(r"^ {0,3}(```|~~~)[^\n]*\n(.*?)(?:^ {0,3}\1[^\n]*$|\Z)", re.M | re.S)


def _from_markdown(s: str, held: Held) -> str:
    s = _FENCE.sub(lambda m: held.put("```\n" + m[2] + "```"), s)
    s = re.sub(r"`[^`\n]+`", lambda m: held.put(m[0]), s)
    out = []
    for line in s.split("\n"):
        line = re.sub(r"!?\[([^\[\]\n]+)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)", r"\1", line)
        line = re.sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"\1", line)
        line = re.sub(r"(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", r"\1", line)
        line = re.sub(r"^ {0,3}>[ \t]*(?=[^\s\d=])", "", line)
        line = re.sub(r"^( {0,3})\+([ \t]+\S)", r"\1-\2", line)
        if re.match(r"[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*:?-*:?[ \t]*\|?[ \t]*$", line):
            continue
        if line.count("|") >= 3 and line.strip().startswith("|"):
            line = " | ".join(x.strip() for x in line.strip().strip("|").split("|"))
        out.append(line)
    return "\n".join(out)


# Commands that go with their argument, and what opens and closes the argument of some others.
_DROP = re.compile(r"(?:cite[a-z]*|eqref|ref|pageref|autoref|label|bibliography|bibliographystyle|usepackage|documentclass|includegraphics|vspace|hspace|input|include|index)$")
_HEADINGS = {"part": 1, "chapter": 1, "title": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}
_AROUND_ARGUMENT = {name: ("\n" + "#" * n + " ", "\n") for name, n in _HEADINGS.items()} | {"footnote": (" (", ")"), "footnotetext": (" (", ")")}
_TEX_PIECE = re.compile(
    r"\\item\b(?:\[(?P<label>[^\]\n]*)\])?[ \t]*|\\(?P<env>begin|end)\s*\{(?P<name>[^{}\n]*)\}(?:\[[^\]\n]*\])?"
    r"|\\(?P<command>[A-Za-z@]+)\*?(?:\[[^\]\n]*\])?(?P<brace>\{)?[ \t]*|\\(?P<escaped>[%&#_$~{}])|(?P<open>\{)|(?P<close>\})|(?P<text>[^\\{}]+|\\)"
)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\*?\}(?:\[[^\]\n]*\])?\n?")


def _from_latex(s: str, held: Held) -> str:
    """One scan with a stack of open braces, so arguments may be nested to any depth."""
    s = _replaced(s, _VERBATIM, lambda code: "\n" + held.put("```\n" + code.rstrip("\n") + "\n```") + "\n", r"\\end\{{{}\*?\}}")
    s = re.sub(r"\\verb\*?([^A-Za-z\s*])(.*?)\1", lambda m: held.put("`" + m[2] + "`"), s)
    out: list[str] = []
    # For each open brace what its close gives, and how much was there before an argument that goes.
    stack: list[tuple[str, int | None]] = []
    link = False
    for m in _TEX_PIECE.finditer(s):
        kind = m.lastgroup
        if m[0].startswith("\\item") and m["command"] is None:
            out.append("\n- " + (m["label"] + " " if m["label"] else ""))
        elif m["env"]:
            out.append("\n")
        elif m["command"]:
            name = m["command"]
            if not m["brace"]:
                out.append(" ")
            elif _DROP.match(name) or name in ("href", "textcolor", "color"):
                while out and not out[-1].strip(" \t~"):
                    out.pop()
                if out and name not in ("href", "textcolor"):
                    out[-1] = out[-1].rstrip(" \t~")
                stack.append(("", len(out)))
            else:
                before, after = _AROUND_ARGUMENT.get(name, ("", ""))
                out.append(before)
                stack.append((after, None))
        elif m["escaped"]:
            out.append(m["escaped"])
        elif kind == "open":
            after = s[m.end() : m.end() + 1] == "\\" or s[m.start() - 1 : m.start()] == "}" and link
            stack.append(("", None) if after else ("}", None))
            out.append("" if after else "{")
        elif kind == "close":
            after, length = stack.pop() if stack else ("}", None)
            if length is not None:
                del out[length:]
                out.append(" " if s[m.end() : m.end() + 1] == "{" else "")
            out.append(after)
        else:
            out.append(m[0])
        link = kind == "close" and (not out or out[-1] != "}")
    return re.sub(r"(?<=\w)~(?=[\w\ue000(])|(?<=\ue001)~|~(?=\ue000)", " ", "".join(out))


def clean(text: str) -> tuple[list[str], str]:
    """Families of text and its clean form: headings as #, list items as -, cells between bars, code verbatim between marks, formulas as they were.

    Of what stands before and after the best content region only links, menus
    and forms go. A text without markup comes out as it is.
    """
    bare, held = hold(text)
    tags = scan(bare)
    seen = {tag[2] for tag in tags}
    found = [name for name in FAMILIES if name in seen]
    if not found:
        return found, text
    if "html" in found or "markdown" in found:
        bare = without_menus(bare, content_region(bare, tags))
    if "markdown" in found:
        bare = _from_markdown(bare, held)
    if "html" in found:
        bare = _from_html(bare, held)
    if "wiki" in found:
        bare = _from_wiki(bare)
    if "latex" in found:
        bare = _from_latex(bare, held)
    bare = re.sub(r"[ \t]+", " ", bare)
    bare = re.sub(r" ?\n ?", "\n", bare)
    return found, held.back(re.sub(r"\n{3,}", "\n\n", bare).strip())


_GAP_PATTERN = r"[^0-9A-Za-z_\u00C0-\u024F\u0370-\u03FF\u0400-\u04FF]+"
_TOKEN_GAP = re.compile(_GAP_PATTERN)


def text_tokens(text: str) -> list[str]:
    """Words of clean prose, lower-cased, placeholders dropped."""
    parts = _TOKEN_GAP.sub(" ", FORMULA.sub(" ", text).lower()).split()
    return [p for p in parts if not re.fullmatch(r"math_\d+", p)]


def clean_texts(rows: DataFrame, id_cols: tuple[str, ...], text_col: str, cleaned: bool = True) -> DataFrame:
    """(id columns..., families, clean_text, tokens) of every row with a text; families alone if cleaned is not asked for.

    A formula keeps its text and place; code keeps its marks, its line breaks and
    its indentation. A text without markup comes out as it is, an empty one
    empty; a null text has no row. Null ids pass through. Repeated rows give
    repeated results. Only texts with a mark that markup could start with leave
    the JVM; whole texts are worked on in Arrow batches, without a shuffle.
    """
    types = dict(rows.dtypes)
    texts = rows.where(F.col(text_col).isNotNull()).select(*id_cols, F.col(text_col).alias("__text"))
    bare = F.regexp_replace("__text", FORMULA_PATTERN, " ")
    ids = ", ".join(f"`{c}` {types[c]}" for c in id_cols)
    schema = f"{ids}, families array<string>" + (", clean_text string, tokens array<string>" if cleaned else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, values = [batch.column(c) for c in id_cols], batch.column("__text").to_pylist()
            if cleaned:
                out = [clean(t) for t in values]
                cols.append(pa.array([f for f, _ in out], pa.list_(pa.string())))
                cols.append(pa.array([c for _, c in out], pa.string()))
                cols.append(pa.array([text_tokens(c) for _, c in out], pa.list_(pa.string())))
            else:
                cols.append(pa.array([families(t) for t in values], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, names=[*id_cols, "families", "clean_text", "tokens"][: len(cols)])

    marked = texts.where(bare.rlike(SUSPECT)).mapInArrow(run, schema)
    plain = texts.where(~bare.rlike(SUSPECT)).select(*id_cols, F.array().cast("array<string>").alias("families"), F.col("__text").alias("clean_text"), bare.alias("__bare"))
    if not cleaned:
        return marked.unionByName(plain.select(*id_cols, "families"))
    words = F.filter(F.split(F.regexp_replace(F.lower("__bare"), _GAP_PATTERN, " "), " "), lambda t: (t != "") & ~t.rlike(r"^math_\d+$"))
    return marked.unionByName(plain.select(*id_cols, "families", "clean_text", words.alias("tokens")))
