"""Fixed values of the tokenizers: stop words and the LaTeX commands that words and symbols stand for."""

from __future__ import annotations

# English stop words dropped from queries.
STOPWORDS = """
the and for with that this from into onto over under between among about above below
is are was were be been being of in to by on as at or an a it its their there
we you he she they them his her our ours your yours my mine me i us one two three
using use used via such these those which who whom whose both either neither each every
can could may might must shall should will would do does did done have has had having
also thus hence therefore etc eg ie vs et al
""".split()

# Environments taken as display math.
MATH_ENVIRONMENTS = (
    "equation", "equation*", "align", "align*", "gather", "gather*",
    "multline", "multline*", "eqnarray", "eqnarray*", "alignat", "alignat*",
)

# Command variants and the command they are counted as.
VARIANTS = {r"\varepsilon": r"\epsilon", r"\varphi": r"\phi", r"\vartheta": r"\theta", r"\varsigma": r"\sigma"}

# Words and the command they hint at; Greek letter names hint at the command of that name.
GREEK_NAMES = (
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu "
    "nu xi pi rho sigma tau upsilon phi chi psi omega"
).split()
WORD_HINTS = {
    "forall": r"\forall", "thereexists": r"\exists", "exists": r"\exists", "implies": r"\implies", "iff": r"\iff",
    "sum": r"\sum", "summation": r"\sum", "product": r"\prod", "coproduct": r"\coprod",
    "integral": r"\int", "doubleintegral": r"\iint", "tripleintegral": r"\iiint",
    "gradient": r"\nabla", "grad": r"\nabla", "partial": r"\partial", "union": r"\cup", "intersection": r"\cap",
    "subset": r"\subset", "subseteq": r"\subseteq", "supset": r"\supset", "supseteq": r"\supseteq",
    "infinity": r"\infty", "emptyset": r"\emptyset", "nabla": r"\nabla", "in": r"\in", "notin": r"\notin",
} | {name: "\\" + name for name in GREEK_NAMES}

# Symbols and the commands they stand for.
SYMBOL_HINTS = {
    "±": [r"\pm"], "∈": [r"\in"], "∉": [r"\notin"], "⊆": [r"\subseteq"], "⊂": [r"\subset"], "⊇": [r"\supseteq"], "⊃": [r"\supset"],
    "≤": [r"\leq"], "≥": [r"\geq"], "≠": [r"\neq"], "≈": [r"\approx"], "≪": [r"\ll"], "≫": [r"\gg"], "∑": [r"\sum"],
    "→": [r"\to"], "←": [r"\leftarrow"], "↔": [r"\leftrightarrow"], "⇒": [r"\implies"], "⇔": [r"\iff"],
    "⋅": [r"\cdot"], "·": [r"\cdot"], "∗": [r"\ast"], "‖": [r"\Vert", r"\|"], "∥": [r"\Vert", r"\|"],
    "⟨": [r"\langle"], "⟩": [r"\rangle"], "⊥": [r"\perp"], "∇": [r"\nabla"], "∂": [r"\partial"], "∪": [r"\cup"], "∩": [r"\cap"],
    "∞": [r"\infty"], "∅": [r"\emptyset"],
    "ℝ": [r"\mathbb", "r"], "ℂ": [r"\mathbb", "c"], "ℤ": [r"\mathbb", "z"], "ℚ": [r"\mathbb", "q"], "ℕ": [r"\mathbb", "n"], "ℙ": [r"\mathbb", "p"],
}

# Greek letters in alphabetical order; omicron has no command and stands for the Latin o.
_LOWER = "αβγδεζηθικλμνξοπρστυφχψω"
_UPPER = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
_NAMES = GREEK_NAMES[: GREEK_NAMES.index("xi") + 1] + [""] + GREEK_NAMES[GREEK_NAMES.index("xi") + 1 :]
GREEK_HINTS = {c: ["\\" + n if n else "o"] for c, n in zip(_LOWER, _NAMES)} | {
    c: ["\\" + n.capitalize() if n else "O"] for c, n in zip(_UPPER, _NAMES)
}

# Pairs of neighbouring tokens and the command they stand for; the last two in queries only.
BRIDGES = (
    ("-", ">", r"\to"), ("=", ">", r"\implies"), ("<", "-", r"\leftarrow"), ("<", ">", r"\leftrightarrow"),
    ("<", "=", r"\leq"), (">", "=", r"\geq"), ("!", "=", r"\neq"), ("<", "<", r"\ll"), (">", ">", r"\gg"),
)

# Phrases and raw operators in a lower-cased text and the command they stand for; operators in queries only.
PHRASES = (("for all", r"\forall"), ("there exists", r"\exists"), ("if and only if", r"\iff"))
RAW_OPERATORS = (
    ("->", r"\to"), ("=>", r"\implies"), ("<->", r"\leftrightarrow"), ("↔", r"\leftrightarrow"), ("<=", r"\leq"),
    (">=", r"\geq"), ("!=", r"\neq"), ("<<", r"\ll"), (">>", r"\gg"),
)
