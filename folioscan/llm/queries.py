"""Queries of the training-data operators and, where SQL can say them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscan.llm import markup, repetition as rep
from folioscan.llm.distinctive import distinctive_terms
from folioscan.llm.mixing import SourceMix
from folioscan.llm.near_duplicates import NearDuplicates
from folioscan.llm.packing import pack
from folioscan.llm.sizes import label
from folioscan.llm.splitting import split_texts
from folioscan.llm.term_counts import term_counts
from folioscan.llm.vectors import VectorIndex, compared_with_all
from folioscan.runtime import durable, table


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").where(label(F.col("kind")) == "paragraph")


def _duplicates(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(_paragraphs(spark, d), "id", "text", k=3, threshold=0.60, min_words=20, keep=("paper_id",))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _duplicates(spark, d).pairs(different="paper_id")
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return _duplicates(spark, d).classes().select(F.col("id").alias("chunk_id"), "class_id", "links")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "chunk"), "id", "text", keep=("paper_id",))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = _pieces(spark, d).where("n_pieces > 1 and piece_no = 0")
    return pieces.select(F.col("id").alias("chunk_id"), "cut")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).withColumnRenamed("id", "chunk_id")


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of every chunk cover: its characters, counted from offsets, and whether all pieces keep the rules."""
    before = F.lag("end").over(Window.partitionBy("id").orderBy("piece_no"))
    gap = F.col("start") - F.coalesce(before, F.lit(0))
    own = F.col("end") - F.col("start")
    rules = (own <= 2000) & (gap >= -200) & (gap <= 1) & (F.length("piece") == own) & (F.col("forced") <= (F.col("cut") == "forced"))
    seen = _pieces(spark, d).withColumn("gap", gap).withColumn("fits", rules)
    # The boundary after the last piece may end the text.
    return seen.groupBy(F.col("id").alias("chunk_id")).agg(
        F.sum(own + F.col("gap")).alias("chars"), F.first("cut").alias("cut"), F.min("fits").alias("fits"), (F.max("piece_no") + 1 == F.max("n_pieces")).alias("whole")
    )


def _cleaned(spark: SparkSession, d: str) -> DataFrame:
    rows = _paragraphs(spark, d).where("id is not null").groupBy("id").agg(F.min("text").alias("text"))
    return markup.clean_texts(rows, ("id",), "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The whole operator, scan, content region and clean form, on one text a chunk; last of all, the families of the tags that the scan found."""
    rows = _cleaned(spark, d).where("clean_text is not null and size(families) > 0")
    return rows.select(F.col("id").alias("chunk_id"), F.explode("families").alias("family"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return _cleaned(spark, d).select(F.col("id").alias("chunk_id"), F.array_join("families", ",").alias("families"), "clean_text", F.size("tokens").alias("n_tokens"))


def p3_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where(label(F.col("kind")) == "paragraph").select("arxiv_id", "id", "text").distinct()
    out = markup.clean_texts(rows, ("arxiv_id", "id"), "text")
    return out.select("arxiv_id", "id", F.posexplode("tokens").alias("pos", "token"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive_terms(table(spark, d, "posting")).where("share >= 0.45 and terms >= 20")
    chunks = _paragraphs(spark, d).select(F.col("id").alias("chunk_id")).distinct()
    return scored.join(chunks, "chunk_id", "left_semi").select("chunk_id", "token_id").distinct()


def p5_weights(spark: SparkSession, d: str) -> DataFrame:
    scored = distinctive_terms(table(spark, d, "posting"))
    return scored.select("chunk_id", "token_id", F.round("ppmi", 6).alias("ppmi"), F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = VectorIndex(table(spark, d, "chunk_svd"), "id", "v").close(0.90)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunk_svd")
    near = VectorIndex(rows, "id", "v").nearest(10, rows.where("id % 20 = 0").select("id"))
    return near.select("id", "other", F.round("cosine", 6).alias("cosine"), "rank")


def p6_recall(spark: SparkSession, d: str) -> DataFrame:
    """The recall of nearest() for 400 ids, those of least hash, against comparing them with every vector."""
    rows = table(spark, d, "chunk_svd")
    index = VectorIndex(rows, "id", "v")
    queries = durable(index.ids.orderBy(F.xxhash64("id"), "id").limit(400).select("id"), "recall-queries")
    want = compared_with_all(index, queries).select("id", "other")
    got = index.nearest(10, queries).select("id", "other").withColumn("hit", F.lit(1))
    return want.join(got, ["id", "other"], "left").agg(
        F.countDistinct("id").alias("queries"), F.count(F.lit(1)).alias("neighbours"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall")
    )


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(table(spark, d, "posting"), table(spark, d, "token"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("band <> 'useful'").select("term", "band")


def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), "doc_id", "text").where("n_pieces > 1 and piece_no = 0").select(F.col("id").alias("doc_id"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_totals(spark: SparkSession, d: str) -> DataFrame:
    """What the containers hold in all: documents, pieces, tokens, split documents, and how many containers are over capacity."""
    rows = pack(table(spark, d, "documents"), "doc_id", "text")
    over = rows.groupBy("container_id").agg(F.sum("length").alias("held")).where("container_id is not null and held > 2048").agg(F.count(F.lit(1)).alias("over_capacity"))
    first = F.col("piece_no") == 0
    sums = rows.agg(
        F.sum(first.cast("long")).alias("documents"), F.sum((F.col("length") > 0).cast("long")).alias("pieces"), F.sum("length").alias("tokens"),
        F.sum((first & (F.col("n_pieces") > 1)).cast("long")).alias("split"), F.sum(((F.col("length") > 0) & F.col("container_id").isNull()).cast("long")).alias("unplaced"),
    )
    return sums.withColumn("k", F.lit(1)).join(over.withColumn("k", F.lit(1)), "k").drop("k")


def _mix(spark: SparkSession, d: str) -> SourceMix:
    return SourceMix(table(spark, d, "documents"), table(spark, d, "mix_target"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares().where("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).documents().withColumnRenamed("id", "doc_id")


def p9_budgets(spark: SparkSession, d: str) -> DataFrame:
    """What each source has and may give; p9_shares without what was taken."""
    return _mix(spark, d).shares().select("source", "target_share", "max_repeats", "available_tokens", F.round("budget_tokens", 6).alias("budget_tokens"), "short")


def p9_totals(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents in the mix, by source: whether none comes more often than it may, and whether their tokens keep to the budget and come within 64 of it."""
    mix = _mix(spark, d)
    shares = mix.shares().select("source", "max_repeats", "budget_tokens", F.least("budget_tokens", F.col("max_repeats") * F.col("available_tokens")).alias("most"), F.col("used_tokens").alias("said"))
    rows = mix.documents().groupBy("source").agg(F.sum(F.col("times") * F.col("n_tokens")).alias("used"), F.max("times").alias("times"))
    return rows.join(shares, "source").select(
        "source", (F.col("times") <= F.col("max_repeats")).alias("repeats_kept"), (F.col("used") == F.col("said")).alias("as_said"),
        (F.col("used") <= F.col("budget_tokens")).alias("not_over"), (F.col("most") - F.col("used") < 65).alias("near"),
    )


def _graded(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return rep.graded(docs, "doc_id", "text", rep.fit_quality(docs, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Graded by the classifier and counted exactly in one pass; the exact share has the last word, since a probability is no share."""
    return _graded(spark, d).where("words > 0 and repeated * 10 >= words * 3").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    shares = rep.graded(table(spark, d, "documents"), "doc_id", "text")
    return shares.select(F.col("id").alias("doc_id"), "words", "repeated", F.round("share", 9).alias("share"))


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).select("doc_id", "probability", "band")


def p10_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Of documents the classifier was not fitted on, by tenths of its probability: their number, mean probability and the share that is repetitive."""
    docs = table(spark, d, "documents")
    n = docs.count()
    fit_rows = min(rep.TRAIN_ROWS, n // 2)
    model = rep.fit_quality(docs, "doc_id", "text", train_rows=fit_rows)
    rows = rep.graded(docs, "doc_id", "text", model).withColumnRenamed("id", "doc_id").where(~rep.in_sample("doc_id", n, fit_rows))
    rows = rows.withColumn("bad", (F.col("repeated") * 10 >= F.col("words") * 3) & (F.col("words") > 0))
    tenth = F.least(F.lit(9), F.floor(F.col("probability") * 10)).cast("int").alias("tenth")
    return rows.groupBy(tenth).agg(
        F.count(F.lit(1)).alias("documents"), F.round(F.avg("probability"), 4).alias("probability"), F.round(F.avg(F.col("bad").cast("int")), 4).alias("repetitive")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_classes, p2_found, p2_pieces, p2_coverage, p3_found, p3_clean, p3_tokens, p5_found, p5_weights, p6_found, p6_nearest, p6_recall,
            p7_found, p7_terms, p8_found, p8_containers, p8_totals, p9_found, p9_shares, p9_budgets, p9_totals, p9_documents, p10_found, p10_shares, p10_quality, p10_calibration,
        )
    }


_LETTER = r"\p{L}\p{N}_"
#: The families' patterns again, without looking around: what stands beside a mark is part of the match.
_MARKS = {
    "html": [markup._TAG, markup._COMMENT, markup._REF],
    "markdown": [
        r"^ {0,3}#{1,6}[ \t]+\S", r"\*\*[^\s*](?:[^*]*[^\s*])?\*\*", rf"(?:^|[^{_LETTER}])__[^\s_](?:[^\n]*[^\s_])?__(?:$|[^{_LETTER}])", r"^ {0,3}(?:```|~~~)", r"`[^`\n]+`",
        r'(?:^|[^\[])!?\[[^\[\]\n]+\]\([^()\s]+(?:\s+"[^"]*")?\)', r"^ {0,3}[-+][ \t]+\S", r"^ {0,3}>[ \t]*[^\s\d=]", r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+[ \t]*:?-*:?[ \t]*\|?[ \t]*$",
    ],
    "wiki": [
        r"\[\[[^\[\]\n]+\]\]", r"\{\{[ \t]*[A-Za-z#!:][^{}]*\}\}", r"^[ \t]*\{\|",
        *[rf"(?:^|[^{_LETTER}')\]])'{{{n}}}[^\s'](?:[^\n]*[^\s'])?'{{{n}}}(?:$|[^{_LETTER}'])" for n in (2, 3, 4, 5)],
        *[rf"^={{{n}}}[ \t]*[^\s=][^\n]*={{{n}}}[ \t]*$" for n in range(1, 7)],
    ],
    "latex": [r"\\(?:begin|end)\s*\{", r"\\[A-Za-z@]+"],
}


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _found_marks() -> str:
    tests = " union all ".join(
        f"select chunk_id, '{name}' as family from b where regexp_matches(bare, {_sql_text(('(?ims)' if name == 'html' else '(?m)') + '|'.join(f'(?:{p})' for p in patterns))})" for name, patterns in _MARKS.items()
    )
    return f"""with t as (select id as chunk_id, min(text) as text from chunk where lower(trim(kind)) = 'paragraph' and id is not null and text is not null group by 1),
        b as (select chunk_id, regexp_replace(text, {_sql_text(markup.FORMULA_PATTERN)}, chr(57344), 'g') as bare from t) {tests}"""


_FACTS = "select distinct token_id, chunk_id, tf from posting where token_id is not null and chunk_id is not null"
_WEIGHTS = f"""
with facts as ({_FACTS}),
n as (select count(distinct chunk_id) as n from facts),
df as (select token_id, count(distinct chunk_id) as df, sum(tf) as term_tf from facts group by 1),
w as (select f.*, df.term_tf, (1 + ln(tf)) * (ln((1.0 + n.n) / (1 + df.df)) + 1) as w from facts f join df using (token_id) cross join n),
c as (select chunk_id, sqrt(sum(w * w)) as norm, sum(tf) as chunk_tf, count(distinct token_id) as terms from w group by 1),
s as (select sum(chunk_tf) as total, sum(pow(chunk_tf, 0.75)) as contexts from c)
"""
_DUCK_TOKENS = r"(coalesce(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{Z}\t\n\x0b\f\r\x1c-\x1f\x{85}]')), 0))"
_LABEL = "lower(trim(source))"
_TERMS = """
with names as (select distinct id as token_id, lower(trim(nfc_normalize(term))) as term from token where id is not null and term is not null),
facts as (select distinct token_id, chunk_id, tf from posting where chunk_id is not null),
n as (select count(distinct chunk_id) as n from facts),
t as (select term, count(distinct chunk_id) as chunks, sum(tf) as total_tf from facts join names using (token_id) group by 1),
b as (select term, chunks, total_tf, case when chunks <= 2 then 'rare' when chunks >= 0.15 * n then 'common' else 'useful' end as band from t cross join n)
"""
_MIX = f"""
with d as (select {_LABEL} as source, {_DUCK_TOKENS} as n from documents where doc_id is not null),
own as (select source, sum(n) as n from d group by 1), total as (select sum(n) as n from d)
select lower(trim(m.source)) as source from mix_target m left join own on own.source = lower(trim(m.source)) cross join total
where m.max_repeats * coalesce(own.n, 0) < m.target_share * total.n
"""


_SHARES = f"""
with d as (select {_LABEL} as source, {_DUCK_TOKENS} as n from documents where doc_id is not null),
own as (select source, sum(n)::bigint as n from d group by 1), total as (select sum(n)::bigint as n from d),
s as (select lower(trim(m.source)) as source, target_share, max_repeats, coalesce(own.n, 0) as available_tokens, round(target_share * total.n, 6) as budget_tokens,
    max_repeats * coalesce(own.n, 0) < target_share * total.n as short from mix_target m left join own on own.source = lower(trim(m.source)) cross join total)
"""
_SHINGLES = r"""
with recursive c as (select id, min(paper_id) as paper_id, min(text) as text from chunk where lower(trim(kind)) = 'paragraph' and id is not null and text is not null group by 1),
w as (select id, paper_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from c),
g as (select distinct id, s from (select id, array_to_string(w[i:i+2], ' ') as s from (select id, w, unnest(generate_series(1, len(w) - 2)) as i from w where len(w) >= 20))),
n as (select id, count(*) as n from g group by 1),
p as (select x.id as a, y.id as b, count(*) as common from g x join g y using (s) where x.id < y.id group by 1, 2),
l as (select a, b from p join n x on x.id = a join n y on y.id = b where common >= 0.6 * (x.n + y.n - common) - 1e-9),
e as (select a, b from l union all select b, a from l),
r as (select id as a, id as b from n union select r.a, e.b from r join e on e.a = r.b)
"""
_UNITS = """
with v as (select id, any_value(v) as v from chunk_svd where id is not null and len(v) = 64 and len(list_filter(v, lambda x: x is not null and isfinite(x))) = 64
    and len(list_filter(v, lambda x: x <> 0)) > 0 group by id),
u as (select id, list_transform(v::double[], lambda x: x / sqrt(list_dot_product(v::double[], v::double[]))) as v from v),
"""
_RUNS = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, unnest(generate_series(1, len(w) - 4)) as i, w from w where len(w) >= 5),
h as (select doc_id, i, row_number() over (partition by doc_id, w[i:i+4] order by i) as k from g),
p as (select distinct doc_id, i + o.o as pos from h, (select unnest(range(5)) as o) o where k > 1),
r as (select doc_id, count(*) as repeated from p group by 1),
s as (select doc_id, len(w)::bigint as n, coalesce(repeated, 0)::bigint as repeated from w left join r using (doc_id))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"{_SHINGLES} select a as chunk_a, b as chunk_b from l join c x on x.id = a join c y on y.id = b where x.paper_id <> y.paper_id",
        "p1_classes": f"{_SHINGLES}, k as (select a, min(b) as class_id from r group by 1) select n.id as chunk_id, class_id, (select count(*) from e where e.a = n.id) as links from n join k on k.a = n.id",
        "p6_found": f"""{_UNITS} s as (select a.id as id, b.id as other, list_dot_product(a.v, b.v) as cosine from u a join u b on a.id <> b.id),
            t as (select *, row_number() over (partition by id order by cosine desc, other) as r from s)
            select distinct least(id, other) as id_a, greatest(id, other) as id_b from t where r <= 10 and cosine >= 0.9""",
        "p6_nearest": f"""{_UNITS} s as (select a.id as id, b.id as other, list_dot_product(a.v, b.v) as cosine from u a join u b on a.id <> b.id where a.id % 20 = 0),
            t as (select *, row_number() over (partition by id order by cosine desc, other) as r from s)
            select id, other, round(cosine, 6) as cosine, r::int as rank from t where r <= 10""",
        "p6_recall": f"{_UNITS} n as (select least(400, count(*)) as n from u) select n as queries, 10 * n as neighbours, 1.0::double as recall from n",
        "p8_totals": f"""select count(*) as documents, sum(ceil(n / 2048.0))::bigint as pieces, sum(n)::bigint as tokens, count(*) filter (n > 2048) as split, 0::bigint as unplaced, 0::bigint as over_capacity
            from (select {_DUCK_TOKENS} as n from documents where doc_id is not null)""",
        "p9_budgets": f"{_SHARES} select * from s",
        "p9_totals": f"{_SHARES} select source, true as repeats_kept, true as as_said, true as not_over, true as near from s where available_tokens > 0",
        "p2_found": r"""
            with t as (select distinct id as chunk_id, text from chunk where id is not null and length(text) > 2000),
            s as (select chunk_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?;]|\\\\)\s', '\1' || chr(10), 'g'), '\r', chr(10), 'g'), '\n')) as part from t)
            select chunk_id, case when max(length(part)) > 2000 then 'forced' else 'natural' end as cut from s group by 1""",
        "p2_coverage": r"""
            with t as (select id as chunk_id, max(text) as text from chunk where id is not null and length(text) > 0 group by 1),
            s as (select chunk_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace(text, '([.!?;]|\\\\)\s', '\1' || chr(10), 'g'), '\r', chr(10), 'g'), '\n')) as part from t)
            select chunk_id, length(any_value(text))::bigint as chars, case when length(any_value(text)) > 2000 and max(length(part)) > 2000 then 'forced' else 'natural' end as cut, true as fits, true as whole
            from s join t using (chunk_id) group by 1""",
        "p3_found": _found_marks(),
        "p5_found": f"""{_WEIGHTS} select distinct w.chunk_id, w.token_id from w join c using (chunk_id)
            where w.w / c.norm >= 0.45 and c.terms >= 20
            and w.chunk_id in (select id from chunk where lower(trim(kind)) = 'paragraph')""",
        "p5_weights": f"""{_WEIGHTS} select w.chunk_id, w.token_id,
            round(greatest(0.0, ln((w.tf / s.total) / ((w.term_tf / s.total) * (pow(c.chunk_tf, 0.75) / s.contexts)))), 6) as ppmi,
            round(w.w, 6) as weight, round(w.w / c.norm, 6) as share from w join c using (chunk_id) cross join s""",
        "p7_found": f"{_TERMS} select term, band from b where band <> 'useful'",
        "p7_terms": f"{_TERMS} select * from b",
        "p8_found": f"select doc_id from documents where {_DUCK_TOKENS} > 2048",
        "p9_found": _MIX,
        "p10_found": f"{_RUNS} select doc_id from s where n > 0 and repeated * 10 >= n * 3",
        "p10_shares": f"{_RUNS} select doc_id, n as words, repeated, round(repeated / greatest(n, 1), 9) as share from s",
    }
