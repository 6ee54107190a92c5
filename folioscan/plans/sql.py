"""The core's queries in SQL, built from shared common table expressions."""

from __future__ import annotations

from folioscan.functions import hints
from folioscan.plans import fixtures

_WS = r"[\s\p{Z}\x{85}\x0b]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def singular(t: str) -> str:
    """The singular of a lower-cased term t."""
    n = f"length({t})"
    return (
        f"case when {n} < 4 then {t} when {t} like '%ies' and {n} > 4 then left({t}, {n} - 3) || 'y' "
        f"when {t} like '%sses' or {t} like '%zzes' then left({t}, {n} - 2) "
        f"when regexp_matches({t}, '(s|x|z|ch|sh)es$') then left({t}, {n} - 2) "
        f"when {t} like '%s' and {t} not like '%ss' then left({t}, {n} - 1) else {t} end"
    )


NOT_WORD = r"[^0-9A-Za-z_\x{00C0}-\x{024F}\x{0370}-\x{03FF}\x{0400}-\x{04FF}]+"
MATH = r"\\\[[\s\S]*?\\\]|\\\([\s\S]*?\\\)|\$\$[\s\S]*?\$\$|\$[\s\S]*?\$"


def words(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower({text}), '{NOT_WORD}', ' ', 'g'), ' '), lambda x: x <> '')"


INDEX = """
chk0 as (select id as chunk_id, min(paper_id) as paper_id, min(lower(trim(kind))) as kind, min(text) as text from chunk where id is not null group by 1),
names as (select distinct id, term from token where id is not null and term is not null),
tk as (select term, min(id) as token_id from names group by 1),
ids as (select distinct names.id, tk.token_id from names join tk using (term)),
facts as (select distinct token_id as id, chunk_id, tf from posting where token_id is not null and chunk_id is not null and tf > 0),
post as (select ids.token_id, f.chunk_id, sum(f.tf) as tf from facts f join ids using (id) where f.chunk_id in (select chunk_id from chk0) group by 1, 2),
dfs as (select token_id, count(*) as df from post group by 1),
tok as (select tk.token_id, tk.term, coalesce(dfs.df, 0) as df from tk left join dfs using (token_id)),
len as (select chunk_id, sum(tf) as dl from post group by 1),
st as (select count(*)::double as n, sum(dl) / count(*) as avgdl from len),
nrm as (select p.chunk_id, sqrt(sum(pow((1 + ln(p.tf)) * (ln((1 + st.n) / (1 + tok.df)) + 1), 2))) as norm from post p join tok using (token_id) cross join st group by 1),
chk as (select c.*, nrm.norm, len.dl from chk0 c join nrm using (chunk_id) join len using (chunk_id)),
pap as (select paper_id, arxiv_id, title, year, path from (select id as paper_id, arxiv_id, title, year, path,
    row_number() over (partition by id order by ingested_at desc nulls last, arxiv_id nulls last, title nulls last, year nulls last, path nulls last) as r from paper where id is not null) where r = 1)"""

_HINTS = ", ".join(f"({_quoted(w)}, {_quoted(c)})" for w, c in hints.WORD_HINTS.items())
_PHRASES = ", ".join(f"({_quoted(w)}, {_quoted(c)})" for w, c in hints.PHRASES + hints.RAW_OPERATORS)
_STOP = ", ".join(_quoted(w) for w in hints.STOPWORDS)

#: Tokens of titles; these hold no formulas and no symbols of the hint tables.
QUERY_TOKENS = f"""
qs as (select paper_id as query_id, title as query from pap where paper_id % 20 = 0 and title is not null),
base as (select query_id, {singular("w")} as term from (select query_id, unnest({words("query")}) as w from qs)),
extra as (select query_id, {singular("term")} as term from base where {singular("term")} <> term
    union select b.query_id, h.c from base b join (values {_HINTS}) h(w, c) on b.term = h.w
    union select query_id, p.c from qs join (values {_PHRASES}) p(w, c) on contains(lower(query), p.w)),
toks as (select query_id, term from base union all select query_id, term from extra)"""


def query_terms(no_filter: bool = False) -> str:
    where = "" if no_filter else f"where length(term) >= 2 and term not in ({_STOP})"
    return f"{QUERY_TOKENS}, qt as (select query_id, term, count(*) as cnt from toks {where} group by 1, 2)"


def vectors(no_filter: bool = False, top_m: int = 12, budget: int | None = 2_000_000) -> str:
    keep = "select *, true as keep from kt cross join st" if no_filter else (
        "select *, not (coalesce(df, 0) >= 200000 or coalesce(df, 0) / st.n >= 0.15) as keep from kt cross join st"
    )
    few = "true" if no_filter else "(cn >= 3 or rr <= 3)"
    within = "true" if budget is None else f"(r = 1 or sum(df) over (partition by query_id order by idf desc, token_id desc rows unbounded preceding) <= {budget})"
    return f"""{INDEX}, {query_terms(no_filter)},
kt as (select * exclude (hit) from (select q.*, t.token_id, t.df, max(case when t.token_id is not null then 1 else 0 end) over (partition by q.query_id) as hit from qt q left join tok t using (term)) where hit = 1),
f1 as ({keep}),
f2 as (select *, max(keep::int) over (partition by query_id) as any_keep from f1),
f3 as (select *, count(*) over (partition by query_id) as cn, row_number() over (partition by query_id order by case when token_id is null then 1 else 0 end, coalesce(df, 0), term) as rr from f2 where keep or any_keep = 0),
w1 as (select query_id, token_id, term, df, cnt, ln((1 + n) / (1 + df)) + 1 as idf from f3 where token_id is not null and {few}),
w2 as (select *, (1 + ln(cnt)) * idf as v, row_number() over (partition by query_id order by idf desc, token_id desc) as r from w1),
vec as (select query_id, token_id, term, df, idf, v / sqrt(sum(v * v) over (partition by query_id)) as q, r <= {top_m} and {within} as chosen from w2)"""


def candidates(most: int = 10_000, kind: str | None = None, no_filter: bool = False, budget: int | None = 2_000_000) -> str:
    test = f"and chunk_id in (select chunk_id from chk where kind = '{kind}')" if kind else ""
    return f"""{vectors(no_filter, budget=budget)},
mat as (select query_id, chunk_id, count(*) as matches from post join vec using (token_id) where chosen {test} group by 1, 2),
cand as (select query_id, chunk_id, matches from (select *, row_number() over (partition by query_id order by matches desc, chunk_id) as r from mat) where r <= {most})"""


def scored(**options: object) -> str:
    return f"""{candidates(**options)},
sc as (select v.query_id, p.chunk_id, c.paper_id, c.kind,
    round(sum(v.q * (1 + ln(p.tf)) * v.idf) / (case when c.norm = 0 then 1 else c.norm end), 9) as cosine,
    round(sum(2.2 * p.tf / (p.tf + 1.2 * (1 - 0.75 + 0.75 * c.dl / st.avgdl)) * ln(1 + greatest(0, st.n - v.df + 0.5) / (v.df + 0.5))), 9) as bm25
    from post p join vec v using (token_id) join cand on cand.query_id = v.query_id and cand.chunk_id = p.chunk_id join chk c on c.chunk_id = p.chunk_id cross join st
    group by v.query_id, p.chunk_id, c.paper_id, c.kind, c.norm)"""


def ranked(by: str = "cosine", **options: object) -> str:
    return f"{scored(**options)}, rk as (select *, row_number() over (partition by query_id order by {by} desc, chunk_id) as place from sc)"


def two_pass(top: int) -> str:
    return f"""{scored()},
r1 as (select *, row_number() over (partition by query_id order by bm25 desc, chunk_id) as p1 from sc),
rk as (select *, row_number() over (partition by query_id order by (p1 <= {top}) desc, case when p1 <= {top} then cosine end desc nulls last, p1) as place from r1)"""


def results(body: str, top_k: int = 20, per_paper: int = 1) -> str:
    return f"""{body},
nm as (select rk.*, coalesce(pap.arxiv_id, rk.paper_id::varchar) as arxiv_id from rk left join pap using (paper_id)),
few as (select *, row_number() over (partition by query_id, regexp_replace(arxiv_id, 'v\\d+$', '') order by place) as c from nm),
pos as (select *, row_number() over (partition by query_id order by place) as position from few where c <= {per_paper}),
res as (select pos.query_id, pos.position, pos.arxiv_id as paper_id, pos.chunk_id, pos.kind, left(coalesce(c.text, ''), 2000) as text, cosine, bm25
    from pos join chk c using (chunk_id) where position <= {top_k})"""


def search_sql(body: str, scoring: str = "tfidf", **caps: int) -> str:
    value = "bm25" if scoring == "bm25" else "cosine"
    return f"""with {results(body, **caps)} select query_id, position, paper_id, chunk_id, kind, text, round({value}, 6) as score,
        round(cosine, 6) as cosine, round(bm25, 6) as bm25, '{scoring}' as scoring from res"""


RAG = f"""{candidates(most=2000, no_filter=True, budget=None)},
ord as (select cand.*, c.paper_id, row_number() over (partition by query_id order by matches desc, chunk_id) as o from cand join chk c using (chunk_id)),
fst as (select *, min(o) over (partition by query_id, paper_id) as first, row_number() over (partition by query_id, paper_id order by o) as chunk_rank from ord),
pr as (select *, dense_rank() over (partition by query_id order by first, paper_id) as paper_rank from fst where chunk_rank <= 5),
sel as (select pr.query_id, pr.paper_rank, pr.paper_id, coalesce(pap.arxiv_id, pr.paper_id::varchar) as arxiv_id, pr.chunk_rank, pr.chunk_id from pr left join pap using (paper_id) where paper_rank <= 5),
tx as (select sel.*, regexp_replace(regexp_replace(c.text, '^{_WS}+|{_WS}+$', '', 'g'), '\\[MATH_\\d+\\]', ' ', 'g') as t from sel join chk c using (chunk_id) where length(regexp_replace(c.text, '^{_WS}+|{_WS}+$', '', 'g')) > 0),
blk as (select query_id, paper_rank, arxiv_id, string_agg(t, chr(10) || chr(10) order by chunk_id) as text from tx group by 1, 2, 3),
rm as (select *, 24000 - coalesce(sum(length(text)) over (partition by query_id order by paper_rank rows between unbounded preceding and 1 preceding), 0) as room from blk where length(text) > 0),
pk as (select query_id, paper_rank, arxiv_id, left(text, room::bigint) as sent, length(left(text, room::bigint)) as sent_chars, length(text) as total_chars, length(text) > room as truncated from rm where room > 0)"""

_UNIQUE = "select distinct on (arxiv_id, id) * from chunks where arxiv_id is not null and id is not null"
_LATEST = """select * exclude (r) from (select * exclude (arxiv_id), a as arxiv_id, row_number() over (partition by a order by ts desc nulls last, title nulls last, abstract nulls last, doi nulls last, source nulls last) as r
    from (select *, regexp_replace(case when regexp_matches(trim(arxiv_id), 'v\\d+$') then split_part(trim(arxiv_id), 'v', 1) else trim(arxiv_id) end, '^([A-Za-z\\-]+)_(\\d{7})$', '\\1/\\2') as a from paper_meta) where a is not null) where r = 1"""
_NUMBER = "try_cast(regexp_extract(id, '(\\d+)$', 1) as bigint)"
_TOKEN_PATTERN = r"\\\p{L}+|\\[\s\S]?|[\^_{}\[\]()=+\-*/:,.;<>|!]|[\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}][\p{Nd}\x{00B2}\x{00B3}\x{00B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}.]*|\p{L}[\p{L}\p{N}'']*"
_BARE = """case when text like '$$%' and text like '%$$' then substr(text, 3, greatest(0, length(text) - 4))
    when text like '$%' and text like '%$' then substr(text, 2, greatest(0, length(text) - 2))
    when starts_with(text, '\\[') and ends_with(text, '\\]') then substr(text, 3, greatest(0, length(text) - 4))
    when starts_with(text, '\\(') and ends_with(text, '\\)') then substr(text, 3, greatest(0, length(text) - 4)) else text end"""
_ENDS = r"regexp_replace(regexp_replace(text, '\r\n|[\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n\z', '')"


def _values(rows: list[tuple[str, ...]]) -> str:
    return ", ".join("(" + ", ".join(_quoted(x) for x in row) + ")" for row in rows)


def _normal(a: str) -> str:
    return f"regexp_replace(case when regexp_matches(trim({a}), 'v\\d+$') then split_part(trim({a}), 'v', 1) else trim({a}) end, '^([A-Za-z\\-]+)_(\\d{{7}})$', '\\1/\\2')"


def expansion(of_query: bool) -> str:
    """Tokens (key, pos, t) of kept0 (key, n, t) and raw (key, low): placeholders out, variants unified, then the sorted extras."""
    bridges = hints.BRIDGES if of_query else hints.BRIDGES[:7]
    phrases = hints.PHRASES + (hints.RAW_OPERATORS if of_query else ())
    return f"""
kept1 as (select key, n, coalesce(v.c, t) as t from kept0 left join (values {_values(list(hints.VARIANTS.items()))}) v(w, c) on t = v.w where not regexp_matches(t, '^math_\\d+$')),
kept as (select key, row_number() over (partition by key order by n) - 1 as pos, t, lead(t) over (partition by key order by n) as after from kept1),
extra as (select key, {singular("t")} as t from kept where not starts_with(t, '\\') and {singular("t")} <> t
    union select key, h.c from kept join (values {_HINTS}) h(w, c) on t = h.w
    union select key, b.c from kept join (values {_values(list(bridges))}) b(x, y, c) on t = b.x and after = b.y
    union select key, p.c from raw join (values {_values(list(phrases))}) p(w, c) on contains(low, p.w)),
tokens as (select key, pos, t from kept union all
    select key, coalesce((select max(pos) + 1 from kept k where k.key = e.key), 0) + row_number() over (partition by key order by t) - 1, t from extra e)"""


_SYMBOLS = _values([(c, str(i), command) for c, commands in (hints.SYMBOL_HINTS | hints.GREEK_HINTS).items() for i, command in enumerate(commands)])


def stages(source: str) -> str:
    """The stages of tokenizing the queries of source (key, q)."""
    minus = "replace(q, chr(8722), '-')"
    return f"""with src as ({source}), raw as (select key, lower(q) as low from src),
w0 as (select key, unnest(w) as w, unnest(range(len(w))) as n from (select key, {words(minus)} as w from src)),
wd as (select key, n, {singular("w")} as t from w0),
sg as (select key, unnest(m) as text, unnest(range(len(m))) as s from (select key, regexp_extract_all(q, '{MATH}') as m from src)),
ml as (select key, s, regexp_extract_all(regexp_replace({_BARE}, '\\\\(begin|end)\\{{[^}}]+\\}}', ' ', 'g'), '{_TOKEN_PATTERN}') as m from sg),
mt as (select key, 1000000 + s * 10000 + i as n, lower(t) as t from (select key, s, unnest(m) as t, unnest(range(len(m))) as i from ml)),
ch as (select key, unnest(c) as c, unnest(range(len(c))) as i from (select key, string_split(q, '') as c from src)),
sy as (select key, 2000000000 + min(i * 10 + y.k::int) as n, y.command as t from ch join (values {_SYMBOLS}) y(c, k, command) on ch.c = y.c group by key, y.command),
kept0 as (select * from wd union all select * from mt union all select * from sy), {expansion(True)}
select src.key, coalesce((select string_agg(t, ' ' order by n) from wd where wd.key = src.key), '') as text_tokens,
    coalesce((select string_agg(text, ' ' order by s) from sg where sg.key = src.key), '') as math_segments,
    coalesce((select string_agg(t, ' ' order by n) from mt where mt.key = src.key), '') as math_tokens,
    coalesce((select string_agg(t, ' ' order by pos) from tokens where tokens.key = src.key), '') as final from src"""


_ATTACHED = f"""with {INDEX},
tt as (select paper_id, chunk_id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') as t from chk),
pt as (select paper_id, string_agg(t, chr(10) || chr(10) order by chunk_id) as text from tt where length(t) > 0 group by 1),
fi as (select arxiv_id, min(paper_id) as paper_id from pap group by 1),
att as (select floor(pap.paper_id / 4)::bigint as session_id, pap.paper_id as seq, pap.arxiv_id, pt.text from pap join fi using (arxiv_id) join pt on pt.paper_id = fi.paper_id)"""


def attached(order: str) -> str:
    return f"""{_ATTACHED}, rm as (select *, 24000 - coalesce(sum(length(text)) over (partition by session_id order by {order} rows between unbounded preceding and 1 preceding), 0) as room from att)
        select session_id, {order} as seq, arxiv_id, 'vectors' as mode, left(text, room::bigint) as sent, length(left(text, room::bigint)) as sent_chars, length(text)::bigint as total_chars, length(text) > room as truncated from rm where room > 0"""


CLIENT = f"""with {vectors(no_filter=True, budget=None).strip()},
cl as (select query_id, arxiv_id, min(query_id + 40 - paper_id) as pos from qs join pap on paper_id between query_id and query_id + 40 where arxiv_id is not null group by 1, 2),
mt as (select v.query_id, p.chunk_id, c.paper_id, cl.arxiv_id, cl.pos, count(*) as m from post p join vec v using (token_id) join chk c using (chunk_id) join pap on pap.paper_id = c.paper_id
    join cl on cl.query_id = v.query_id and cl.arxiv_id = pap.arxiv_id where v.chosen group by all),
od as (select * from (select *, row_number() over (partition by query_id order by m desc, chunk_id) as o from mt) where o <= 2000),
cr as (select *, row_number() over (partition by query_id, paper_id order by o) as chunk_rank from od),
pr as (select *, dense_rank() over (partition by query_id order by pos, paper_id) as paper_rank from cr where chunk_rank <= 5)
select query_id, paper_rank::int as paper_rank, paper_id, arxiv_id, chunk_rank::int as chunk_rank, chunk_id from pr where paper_rank <= 5"""

_ABSTRACT = "We study $x$ and its powers."


def _archive_rows() -> dict[str, str]:
    """What must come of the archives of fixtures.archive_folder, by reading them."""
    nl = "\n"
    # Two comments go: one of 13 characters, one of 11. The files are joined with blank lines.
    chars = len(fixtures.OTHER) + len(fixtures.MAIN) + len("A reference.") + 4 - 13 - 11
    records = [
        ("0704.0001v1", "chunk_0", "paragraph", "article On Noetherian Rings A. One, B. van Two; C. Three and D. Four document abstract We study [MATH_0] and its powers . abstract Start Let [MATH_1] be given.",
            "article on noetherian rings a one b van two c three and d four document abstract we study and its powers abstract start let be given power ring"),
        ("0704.0001v1", "chunk_1", "paragraph", "[MATH_2] [MATH_3]", ""),
        ("0704.0001v1", "chunk_2", "paragraph", "Last foo . equation never closed equation document", "last foo equation never closed equation document"),
        ("0704.0001v1", "chunk_3", "paragraph", "Only prose here, on 50\\% of it.", "only prose here on 50 of it"),
        ("0704.0001v1", "chunk_4", "equation", "$x$", "x"),
        ("0704.0001v1", "chunk_5", "equation", "$a+b$", "a + b"),
        ("0704.0001v1", "chunk_6", "equation", nl.join(("\\begin{gather}", "v = \\alpha", "\\end{gather}")), "v = \\alpha"),
        ("0704.0001v1", "chunk_7", "equation", nl.join(("\\begin{align*}", "u &= 1 \\\\", "y &= 2", "\\end{align*}")), "u = 1 \\\\ y = 2"),
        ("math_0404297", "chunk_0", "paragraph", "document A single file with [MATH_0] . document", "document a single file with document"),
        ("math_0404297", "chunk_1", "equation", "\\(c\\)", "c"),
    ]
    gather = nl.join((r"\begin{gather}", r"v = \alpha", r"\end{gather}"))
    align = nl.join((r"\begin{align*}", r"u &= 1 \\", "y &= 2", r"\end{align*}"))
    return {
        "archive_scan": "select * from (values ('0704.0001v1'), ('math_0404297'), ('0705.0002.TGZ'), ('0706.0003'), ('0707.0004')) v(arxiv_id)",
        "archive_files": f"""select * from (values ('0704.0001v1', 'sub/main.tex', {len(fixtures.MAIN)}), ('0704.0001v1', 'other.tex', {len(fixtures.OTHER)}),
            ('math_0404297', 'main.tex', {len(fixtures.SINGLE)})) v(arxiv_id, member, chars)""",
        "archive_main_files": "select * from (values ('0704.0001v1', 'sub/main.tex', 1), ('0704.0001v1', 'other.tex', 2), ('math_0404297', 'main.tex', 1)) v(arxiv_id, member, place)",
        "math_blocks": f"""select arxiv_id, n::int as n, block from (values ('0704.0001v1', '0', '$x$'), ('0704.0001v1', '1', '$a+b$'), ('0704.0001v1', '2', {_quoted(gather)}),
            ('0704.0001v1', '3', {_quoted(align)}), ('math_0404297', '0', '\\(c\\)')) v(arxiv_id, n, block)""",
        "archive_chunks": f"select * from (values {_values(records)}) v(arxiv_id, id, kind, text, tokens)",
        "chunk_records": """select * from (values ('0704.0001v1', 'chunk_0', 'paragraph', 'a b', 'a b'), ('0704.0001v1', 'chunk_1', 'equation', '$x$', 'x'),
            ('math_0404297', 'chunk_1', 'equation', '$x$', 'x')) v(arxiv_id, id, kind, text, tokens)""",
        "oai_listing": "select * from (values ('0704.0001'), ('math/0404297')) v(arxiv_id)",
        "atom_feed": """select * from (values ('0704.0001', 'Paper 0704.0001v2', 'A', 'math.AC', 'About 0704.0001v2', '10/0704.0001v2', 'arxiv'),
            ('math/0404297', 'Paper math/0404297', 'A', 'math.AC', 'About math/0404297', '10/math/0404297', 'arxiv')) v(arxiv_id, title, authors, subjects, abstract, doi, source)""",
        "latex_sources": f"select '0704.0001v1' as arxiv_id, {chars} as chars, true as with_references",
        "latex_metadata": f"""select * from (values ('0704.0001v1', 'On Noetherian Rings', 'A. One|B. van Two|C. Three|D. Four', {_quoted(_ABSTRACT)}, 'offline_latex')) v(arxiv_id, title, authors, abstract, source)""",
    }


def oracle_sql() -> dict[str, str]:
    return _archive_rows() | {
        "query_cases": f"select key as query_id, * exclude (key) from ({stages('select * from (values ' + ', '.join(f'({i}, {_quoted(q)})' for i, q in enumerate(fixtures.QUERIES)) + ') v(key, q)')})",
        "tokenize_stages": f"select key as paper_id, * exclude (key) from ({stages(f'with {INDEX} select paper_id as key, title as q from pap where title is not null')})",
        "chunk_tokens": f"""with c as (select id as key, min(text) as text, min(lower(trim(kind))) as kind from chunk where id is not null and text is not null group by 1),
            l as (select key, case when kind = 'equation' then list_transform(regexp_extract_all(regexp_replace({_BARE}, '\\\\(begin|end)\\{{[^}}]+\\}}', ' ', 'g'), '{_TOKEN_PATTERN}'), lambda x: lower(x)) else {words('text')} end as w from c),
            raw as (select key, lower(text) as low from c where kind is distinct from 'equation'),
            kept0 as (select key, unnest(range(len(w))) as n, unnest(w) as t from l), {expansion(False)}
            select key as chunk_id, pos::int as pos, t as token from tokens""",
        "metadata_refresh": f"""with p as (select distinct {_normal('arxiv_id')} as asked from paper where arxiv_id is not null), m as (select distinct {_normal('arxiv_id')} as a from paper_meta where arxiv_id is not null)
            select asked, case when asked like '%7' then 'absent' end as error from p where asked not in (select a from m)""",
        "stored_embeddings": f"""select distinct id as chunk_id, 64::int as numbers from chunk_svd where id in (select id from chunk where id % 3 = 0) and len(v) = 64
            and not list_contains(list_transform(v, lambda x: isnan(x)), true) and list_aggregate(list_transform(v, lambda x: abs(x)), 'sum') > 0""",
        "published_index": f"with {INDEX} select token_id, chunk_id, tf, dl from post join len using (chunk_id)",
        "stream_ingest": "select arxiv_id, count(distinct id) as records from chunks where arxiv_id is not null and id is not null group by 1",
        "chat_context": attached("seq"),
        "full_papers": f"select session_id as query_id, seq as paper_rank, * exclude (session_id, seq) from ({attached('-seq')})",
        "client_papers": CLIENT,
        "sessions": """with e as (select user_id as session_id, event_id as seq, floor(value)::bigint::varchar as paper_id, case when event_type = 'click' then 'vectors' else 'latex' end as mode,
                case when event_type in ('view', 'click') then 'add' when event_type = 'purchase' then 'remove' when event_type = 'error' and value > 100 then 'clear' else 'none' end as action from events),
            l as (select *, coalesce(max(case when action = 'clear' then seq end) over (partition by session_id), -1) as cleared,
                coalesce(max(case when action = 'remove' then seq end) over (partition by session_id, paper_id), -1) as removed from e)
            select session_id, min(seq) as seq, paper_id, arg_min(mode, seq) as mode from l where action = 'add' and paper_id is not null and seq > cleared and seq > removed group by session_id, paper_id""",
        "metadata_all": f"""with w as (select distinct regexp_replace(case when regexp_matches(trim(arxiv_id), 'v\\d+$') then split_part(trim(arxiv_id), 'v', 1) else trim(arxiv_id) end, '^([A-Za-z\\-]+)_(\\d{{7}})$', '\\1/\\2') as arxiv_id from paper where arxiv_id is not null),
            m as ({_LATEST}),
            f as (select arxiv_id, left(t, 1200) as abstract from (select arxiv_id, t, row_number() over (partition by arxiv_id order by (kind is not null and lower(trim(kind)) = 'paragraph') desc, {_NUMBER}) as r
                from (select *, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') as t from chunks where arxiv_id is not null) where length(t) > 0) where r = 1),
            c as (select regexp_replace(case when regexp_matches(trim(arxiv_id), 'v\\d+$') then split_part(trim(arxiv_id), 'v', 1) else trim(arxiv_id) end, '^([A-Za-z\\-]+)_(\\d{{7}})$', '\\1/\\2') as arxiv_id, arxiv_id as title, abstract from f),
            u as (select arxiv_id, title, abstract, source, 0 as s from m union all select arxiv_id, title, abstract, 'offline', 2 from c)
            select arxiv_id, title, abstract, source from (select *, row_number() over (partition by arxiv_id order by s, title) as r from u where arxiv_id in (select arxiv_id from w)) where r = 1""",
        "collection_counts": " union all ".join(f"select '{t}' as name, count(*) as rows from {t}" for t in ("token", "paper", "chunk", "posting")),
        "papers_chunk_counts": f"with {INDEX} select pap.paper_id, pap.arxiv_id, count(c.chunk_id) as chunks from pap left join chk c using (paper_id) group by 1, 2",
        "index_build": f"with {INDEX} select token_id, chunk_id, tf from post",
        "token_df": f"with {INDEX} select token_id, term, df from tok",
        "chunk_norms": f"with {INDEX} select chunk_id, round(norm, 6) as norm, dl from chk",
        "corpus_stats": f"with {INDEX} select n::bigint as n_chunks, round(avgdl, 6) as avgdl from st",
        "per_paper_tfidf": f"""with u as ({_UNIQUE}), n as (select arxiv_id, count(*) as n from u group by 1),
            t as (select arxiv_id, id, term, count(*) as tf from (select arxiv_id, id, unnest(tokens) as term from u) where term is not null group by 1, 2, 3),
            d as (select arxiv_id, term, count(*) as df from t group by 1, 2),
            w as (select t.*, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) as w from t join d using (arxiv_id, term) join n using (arxiv_id))
            select arxiv_id, id, term, round(w / sqrt(sum(w * w) over (partition by arxiv_id, id)), 6) as weight from w""",
        "paper_vocabulary": f"""with u as (select distinct arxiv_id, id, term from (select arxiv_id, id, unnest(tokens) as term from chunks where arxiv_id is not null and id is not null) where term is not null)
            select arxiv_id, term, (row_number() over (partition by arxiv_id order by term) - 1)::int as term_idx, count(*) as df from u group by 1, 2""",
        "built_postings": f"""with u as (select *, row_number() over (order by arxiv_id, {_NUMBER} nulls first, id) as chunk_id from ({_UNIQUE} and len(tokens) > 0))
            select term, chunk_id, count(*)::double as tf from (select chunk_id, unnest(tokens) as term from u) where term is not null group by 1, 2""",
        "text_tokens": f"select chunk_id, unnest(range(len(w)))::int as pos, unnest(w) as token from (select id as chunk_id, {words('text')} as w from (select distinct id, text from chunk where lower(trim(kind)) = 'paragraph' and id is not null and text is not null))",
        "singular_terms": f"select term, {singular('lower(term)')} as singular from (select distinct term from token where term is not null)",
        "math_tokens": f"""select chunk_id, unnest(range(len(w)))::int as pos, lower(unnest(w)) as token from (select chunk_id, regexp_extract_all(regexp_replace({_BARE}, '\\\\(begin|end)\\{{[^}}]+\\}}', ' ', 'g'), '{_TOKEN_PATTERN}') as w
            from (select distinct id as chunk_id, text from chunk where lower(trim(kind)) = 'equation' and id is not null and text is not null))""",
        "math_segments": f"select doc_id, unnest(range(len(m)))::int as pos, unnest(m) as segment from (select doc_id, regexp_extract_all(text, '{MATH}') as m from documents where text is not null)",
        "comments_stripped": f"select doc_id, regexp_replace({_ENDS}, '(?m)(^|[^\\\\\\n])%[^\\n]*', '\\1', 'g') as text from documents where text is not null",
        "comments_stripped_lenient": f"select doc_id, regexp_replace({_ENDS}, '(?m)^((?:[^%\\n]*[^%\\\\\\n])?)%[^\\n]*', '\\1', 'g') as text from documents where text is not null",
        "latex_text": f"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\\\[A-Za-z@]+', ' ', 'g'), '[{{}}]', ' ', 'g'), '{_WS}+', ' ', 'g')) as text from documents where text is not null",
        "paragraph_split": f"""select doc_id, unnest(range(len(p)))::int as pos, unnest(p) as paragraph from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{_WS}*\\n'),
            lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') as p from documents where text is not null)""",
        "paper_ids": f"""with {INDEX} select paper_id, regexp_replace(case when regexp_matches(trim(arxiv_id), 'v\\d+$') then split_part(trim(arxiv_id), 'v', 1) else trim(arxiv_id) end, '^([A-Za-z\\-]+)_(\\d{{7}})$', '\\1/\\2') as normal,
            regexp_replace(arxiv_id, 'v\\d+$', '') as base, 'https://arxiv.org/abs/' || regexp_replace(arxiv_id, '^([A-Za-z\\-]+)_(\\d{{7}})(v\\d+)?$', '\\1/\\2') as abs_url,
            'https://arxiv.org/pdf/' || regexp_replace(arxiv_id, '^([A-Za-z\\-]+)_(\\d{{7}})(v\\d+)?$', '\\1/\\2') || '.pdf' as pdf_url from pap""",
        "metadata_cards": f"""with m as ({_LATEST}) select arxiv_id, trim(coalesce(title, arxiv_id)) as title,
            array_to_string(coalesce(authors, [])[1:4], ', ') || case when len(coalesce(authors, [])) > 4 then ' +' || (len(authors) - 4) else '' end as authors_line,
            array_to_string(coalesce(subjects, [])[1:3], ' ') as subjects_line,
            case when length(trim(regexp_replace(coalesce(abstract, ''), '{_WS}+', ' ', 'g'))) > 500 then left(trim(regexp_replace(abstract, '{_WS}+', ' ', 'g')), 500) || '…' else trim(regexp_replace(coalesce(abstract, ''), '{_WS}+', ' ', 'g')) end as abstract_head,
            'https://arxiv.org/abs/' || arxiv_id as abs_url, 'https://arxiv.org/pdf/' || arxiv_id || '.pdf' as pdf_url from m""",
        "metadata_from_chunks": f"""select arxiv_id, left(t, 1200) as abstract from (select arxiv_id, t, row_number() over (partition by arxiv_id order by (kind is not null and lower(trim(kind)) = 'paragraph') desc, {_NUMBER}) as r
            from (select *, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') as t from chunks where arxiv_id is not null) where length(t) > 0) where r = 1""",
        "query_tokens": f"with {INDEX}, {QUERY_TOKENS} select query_id, term, count(*) as cnt from toks group by 1, 2",
        "query_vectors": f"with {vectors()} select query_id, token_id, term, df, round(idf, 6) as idf, round(q, 6) as q, chosen from vec",
        "scan_budget": f"with {vectors(top_m=4, budget=300)} select query_id, token_id, df, chosen from vec",
        "candidates": f"with {candidates()} select query_id, chunk_id, matches from cand",
        "search_cosine": search_sql(ranked()),
        "search_bm25": search_sql(ranked("bm25"), "bm25"),
        "search_two_pass": search_sql(two_pass(2000)),
        "search_kind": search_sql(ranked(kind="paragraph")),
        "search_unfiltered": search_sql(ranked(no_filter=True)),
        "search_per_paper": search_sql(ranked(), top_k=50, per_paper=3),
        "query_dims": f"with {vectors()} select query_id, dim::int as dim, term from (select query_id, term, row_number() over (partition by query_id order by round(abs(q), 9) desc, term) as dim from vec) where dim <= 2",
        "score_bars": f"""with {results(ranked())} select query_id, position, round(greatest(0, least(100, cosine * 100)), 6) as cos_pct,
            round(greatest(0, least(100, bm25 / (case when max(bm25) over (partition by query_id) > 0 then max(bm25) over (partition by query_id) else 1 end) * 100)), 6) as bm25_pct from res""",
        "resorted": f"with {results(ranked())} select query_id, position, (row_number() over (partition by query_id order by bm25 desc, position))::int as new_position from res",
        "rag_select": f"with {RAG} select query_id, paper_rank::int as paper_rank, paper_id, arxiv_id, chunk_rank::int as chunk_rank, chunk_id from sel",
        "rag_context": f"with {RAG} select query_id, paper_rank::int as paper_rank, arxiv_id, sent, sent_chars, total_chars, truncated from pk",
        "offline_summary": f"""with {RAG}, n as (select *, row_number() over (partition by query_id order by paper_rank) as r from pk)
            select query_id, 'Offline mode: LLM unavailable. Showing excerpts related to your question.' || chr(10) || chr(10) || string_agg('- [' || arxiv_id || '] ' || left(trim(regexp_replace(sent, '{_WS}+', ' ', 'g')), 900) || '...', chr(10) order by paper_rank) || chr(10) || chr(10) || 'Tip: Save an OpenAI API key in Settings to enable full answers.' as summary from n where r <= 3 group by 1""",
        "prompts": f"""with {RAG}, p as (select query_id, string_agg('[Source ' || arxiv_id || ']' || chr(10) || sent || chr(10) || chr(10), '' order by paper_rank) as b from pk group by 1)
            select query_id, 'You are a careful assistant. Read the following excerpts to answer the user''s question. Cite papers as [paperId].' || chr(10) || chr(10) || b || 'Question: ' || query || chr(10) || chr(10)
            || 'Answer succinctly with citations like [paperId].' as prompt from p join qs using (query_id)""",
        "previews": f"with {RAG} select query_id, paper_rank::int as paper_rank, arxiv_id, sent_chars as chars, left(sent, 800) as head from pk",
        "paper_texts": f"""with {INDEX}, t as (select paper_id, chunk_id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') as t from chk)
            select paper_id, left(string_agg(t, chr(10) || chr(10) order by chunk_id), 24000) as text, (sum(length(t) + 2) - 2)::bigint as total_chars from t where length(t) > 0 and paper_id is not null group by 1""",
        "public_ids": f"""with {INDEX}, i as (select paper_id::varchar as id from pap union select arxiv_id from pap)
            select id, case when regexp_matches(id, '[./v]') then id else coalesce(pap.arxiv_id, id) end as public_id from i left join pap on pap.paper_id::varchar = id where id is not null""",
        "allowlist_ingest": "select arxiv_id, count(*) as records from chunks where arxiv_id in (select distinct arxiv_id from paper where year = 2010) group by 1",
        "incremental_ingest": "select arxiv_id, count(*) as records from chunks where arxiv_id not in (select arxiv_id from paper where year <= 2012 and arxiv_id is not null) group by 1",
        "mini_dataset": f"""with p as (select distinct arxiv_id from chunks where arxiv_id is not null order by 1 limit 50)
            select arxiv_id, id from (select arxiv_id, id, row_number() over (partition by arxiv_id order by {_NUMBER} nulls first, id) as r from (select distinct arxiv_id, id from chunks where arxiv_id in (select arxiv_id from p))) where r <= 200""",
        "sharded": """with p as (select arxiv_id, ((row_number() over (order by arxiv_id) - 1) % 4)::int as shard from (select distinct arxiv_id from chunks where arxiv_id is not null))
            select shard, count(*) as records, count(distinct arxiv_id) as papers from chunks join p using (arxiv_id) group by 1""",
        "latent_blend": f"""with {ranked()},
            em as (select distinct id as chunk_id, v from chunk_svd where len(v) = 64 and not list_contains(list_transform(v, lambda x: isnan(x)), true) and list_aggregate(list_transform(v, lambda x: abs(x)), 'sum') > 0),
            un as (select chunk_id, list_transform(v, lambda x: x::double / sqrt(list_dot_product(v::double[], v::double[]))) as v from em),
            fc as (select paper_id as query_id, min(chunk_id) as chunk_id from chk join un using (chunk_id) group by 1),
            qv as (select fc.query_id, un.v as qv from fc join un using (chunk_id)),
            bl as (select rk.query_id, rk.chunk_id, rk.place, round(case when place <= 2000 and un.v is not null and qv.qv is not null then 0.5 * cosine + 0.5 * list_dot_product(qv.qv, un.v) else cosine end, 9) as cosine
                from rk left join un using (chunk_id) left join qv using (query_id))
            select query_id, chunk_id, round(cosine, 6) as cosine, (row_number() over (partition by query_id order by cosine desc, place))::int as place from bl""",
    }
