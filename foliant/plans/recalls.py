"""Recall by clauses over several fields: question-answer pairs, documents by title, phrase and grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import evidence as E
from foliant.operators import recall as R
from foliant.sources.tables import read_table as read

from .registry import query

QUESTION, PHRASE = "the that was for", "it is the"


def _words(field: str) -> str:
    return f"list_filter(string_split_regex(lower({field}), '[^a-z0-9]+'), lambda t: t <> '')"


def _bm25(f: str, terms: list[str]) -> str:
    """Score of field ``f`` (l_f, t<i>_f) beside its statistics (n_f, a_f, d<i>_f)."""
    one = "case when t{i}_{f} > 0 then ln(1 + (n_{f} - d{i}_{f} + 0.5e0) / (d{i}_{f} + 0.5e0)) * t{i}_{f} * 2.2e0 / (t{i}_{f} + 1.2e0 * (0.25e0 + 0.75e0 * l_{f} / a_{f})) else 0 end"
    return "(" + " + ".join(one.format(i=i, f=f) for i in range(len(terms))) + ")"


def _tf(f: str, terms: list[str]) -> str:
    return f"len(w_{f}) as l_{f}, " + ", ".join(f"len(list_filter(w_{f}, lambda x: x = '{t}')) as t{i}_{f}" for i, t in enumerate(terms))


def _df(f: str, terms: list[str]) -> str:
    return f"count(l_{f}) as n_{f}, avg(l_{f}) as a_{f}, " + ", ".join(f"count(*) filter (t{i}_{f} > 0) as d{i}_{f}" for i in range(len(terms)))


_Q = QUESTION.split()
_HELD = lambda f: " + ".join(f"case when t{i}_{f} > 0 then 1 else 0 end" for i in range(len(_Q)))


@query(f"""
    with t as (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as next_role, lead(text) over (partition by conv_id order by turn) as answer from conversations),
    p as (select conv_id * 1000 + turn as id, {_words('text')} as w_q, {_words('answer')} as w_a from t where role = 'user' and next_role = 'assistant'),
    c as (select id, {_tf('q', _Q)}, {_tf('a', _Q)} from p), s as (select {_df('q', _Q)}, {_df('a', _Q)} from c),
    r as (select id, round(greatest(case when {_HELD('q')} >= 2 then 3 * {_bm25('q', _Q)} else 0 end, case when {_HELD('a')} >= 2 then {_bm25('a', _Q)} else 0 end), 6) as score from c, s)
    select id, score, round(least(score / 10, 1), 4) as confidence, round(round(least(score / 10, 1), 4) * 0.015, 6) as rrf_score from r where score > 0 order by score desc, id limit 10
""")
def qa_word_recall(spark: SparkSession, d: str) -> DataFrame:
    """Earlier answers by words: question^3, answer^1, the better field, at least 60 % of the terms in it."""
    pairs = E.qa_pairs(read(spark, d, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "question", "answer")
    return R.qa_recall(pairs, QUESTION)


_P = PHRASE.split()
_GRAMS = R.query_grams("src3")
_GRAM_TF = ", ".join(f"len(list_filter(range(1, length(source) - {len(g) - 2}), lambda i: lower(source)[i : i + {len(g) - 1}] = '{g}')) as t{i}_g" for i, g in enumerate(_GRAMS))


@query(f"""
    with w as (select doc_id, source, {_words("string_split(text, chr(10))[1]")} as w_title, {_words('text')} as w_terms from documents),
    pos as (select doc_id, unnest(range(1, len(w_terms) + 1)) as p, unnest(w_terms) as t from w),
    adj as (select doc_id, p - i as a, i from pos join (values {", ".join(f"({i}, '{t}')" for i, t in enumerate(_P))}) q(i, t) using (t)),
    near as (select l.doc_id, m, adj.i, min(adj.a) as a from (select distinct doc_id, a as m from adj) l join adj on adj.doc_id = l.doc_id and adj.a >= m group by all),
    ends as (select doc_id, m, max(a) as e from near group by doc_id, m having count(*) = {len(_P)}),
    freq as (select doc_id, sum(1e0 / (1 + e - m)) as f from (select doc_id, e, max(m) as m from ends group by doc_id, e) where e - m <= 3 group by doc_id),
    c as (select w.doc_id, source, coalesce(f, 0) as f, {_tf('title', _P)}, {_tf('terms', _P)}, {_GRAM_TF},
          case when source is not null then list_sum(list_transform(list_filter(string_split_regex(lower(source), '[^a-z0-9]+'), lambda t: t <> ''), lambda t: list_sum(list_transform(range(2, 9), lambda n: greatest(length(t) - n + 1, 0))))) end as l_g from w left join freq using (doc_id)),
    s as (select {_df('title', _P)}, {_df('terms', _P)}, {_df('g', _GRAMS)} from c),
    r as (select doc_id, case when source = 'src3' then 18 else 0 end + 10 * coalesce({_bm25('title', _P)}, 0) + 4 * coalesce({_bm25('terms', _P)}, 0) + 4 * coalesce({_bm25('g', _GRAMS)}, 0)
      + case when f > 0 then 8 * ({" + ".join(f"ln(1 + (n_terms - d{i}_terms + 0.5e0) / (d{i}_terms + 0.5e0))" for i in range(len(_P)))}) * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * l_terms / a_terms)) else 0 end as score from c, s)
    select doc_id, round(score, 6) as score from r where score > 0
""")
def document_clause_recall(spark: SparkSession, d: str) -> DataFrame:
    """Documents by exact source, words of title and text, a phrase up to three places off, and grams of the source, with the boosts of the document recall."""
    docs = read(spark, d, "documents").select("doc_id", "source", F.split("text", "\n")[0].alias("title"), F.col("text").alias("terms"))
    clauses = [R.Exact("source", "src3", 18.0), R.Terms("title", PHRASE, 10.0), R.Terms("terms", PHRASE, 4.0), R.Phrase("terms", PHRASE, 8.0, 3), R.Grams("source", "src3", 4.0)]
    return R.recall(docs, clauses).select("doc_id", F.round("score", 6).alias("score"))
