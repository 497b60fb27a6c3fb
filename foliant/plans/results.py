"""What a search shows: keyword results with snippets, candidates that are vetoed or reranked, documents for a prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import assembly as A
from foliant.operators import evidence as E
from foliant.operators import search as S
from foliant.sources.tables import read_table as read

from .registry import ORACLE_SQL, query
from .retrieval import _LIST, BM25_SQL, TERMS

_MARKED = "{x}"
for _t in sorted(TERMS, key=lambda t: -len(t)):
    _MARKED = f"replace({_MARKED}, '{_t}', '<em class=''highlight''>{_t}</em>')"


@query(f"""
    with {BM25_SQL},
    s as (select doc_id, source as query, lang, text, round(score, 6) as score from bm join documents using (doc_id)),
    k as (select *, row_number() over (partition by query order by score desc, doc_id) as rank, max(score) over (partition by query) as best from s qualify rank <= 5),
    l as (select doc_id, query, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as nth from k),
    hl as (select *, list_sort(list_filter(list_transform([{_LIST}], lambda t, i: {{'at': strpos(x, t), 'i': i, 'n': length(t)}}), lambda p: p['at'] > 0))[1] as p from l),
    c as (select doc_id, query, nth, row_number() over (partition by query, doc_id order by nth) as n, p['at'] - 1 as a, p['n'] as w, x from hl where p is not null),
    t as (select *, greatest(a - 50, 0) as b, least(length(x), a + w + 90) as e from c where n <= 3),
    m as (select doc_id, query, n, nth, case when b > 0 then '...' else '' end || substring(x, b + 1, e - b) || case when e < length(x) then '...' else '' end as x from t),
    g as (select doc_id, query, list(nth order by n) as ids, list({_MARKED.format(x='x')} order by n)[1] as chunk_text from m group by doc_id, query),
    r as (select k.query, 1 as kind, rank as o, k.doc_id, case when k.doc_id % 2 = 0 then lang else 'f' || k.doc_id end as organization, round(greatest(0.05, least(0.99, 0.5 + 0.49 * score / case when best <= 0.001 then 1 else best end)), 4) as score,
            coalesce(chunk_text, {_MARKED.format(x="'f' || k.doc_id")}) as chunk_text, case when ids is null then cast(k.doc_id as varchar) else array_to_string(ids, ',') end as chunk_ids from k left join g using (query, doc_id)),
    f as (select source as query, 0 as kind, doc_id as o, doc_id, case when doc_id % 2 = 0 then lang else 'f' || doc_id end as organization, 0.99 as score, '' as chunk_text, '' as chunk_ids from documents d
          where doc_id % 50 = 7 and not exists (select 1 from k where k.query = d.source and k.doc_id = d.doc_id))
    select query, row_number() over (partition by query order by kind, o, doc_id) as place, doc_id, organization, score, md5(chunk_text) as chunk_md5, chunk_ids from (select * from r union all select * from f)
""")
def keyword_result_page(spark: SparkSession, d: str) -> DataFrame:
    """The first five documents of every source with the lines that hold a term, and some literal hits before them."""
    docs = read(spark, d, "documents")
    named = [F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_name"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("owner"), F.lit("").alias("title")]
    scored = S.bm25(docs, TERMS).select("doc_id", F.round("score", 6).alias("rank_score")).join(docs, "doc_id")
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("rank_score"), "doc_id"))
    terms = F.array(*[F.lit(t) for t in TERMS]).alias("terms")
    top = scored.withColumn("rank", nth).where("rank <= 5")
    lines = top.select(F.col("source").alias("query"), "doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "content"))
    held = F.lit(False)
    for t in TERMS:
        held = held | F.contains("content", F.lit(t))
    chunks = lines.where(held).select("query", "doc_id", "nth", F.col("nth").cast("string").alias("chunk_id"), "content", terms)
    literal = docs.where("doc_id % 50 = 7").select(F.col("source").alias("query"), F.col("doc_id").alias("nth"), "doc_id", *named)
    shown = A.keyword_results(top.select(F.col("source").alias("query"), "rank", "doc_id", *named, F.lit(None).cast("string").alias("summary"), "rank_score", terms), chunks, literal, "query", 5)
    return shown.select("query", "place", "doc_id", "organization", "score", F.md5("chunk_text").alias("chunk_md5"), F.array_join(F.col("chunks.chunk_id"), ",").alias("chunk_ids"))


@query("""
    with s as (select user_id, value / 100 as score, user_id % 5 = 0 as nav from events where event_type <> 'view'),
    g as (select user_id, count(*) as n, count(*) filter (score < 0.6) / count(*) as veto_ratio, coalesce(bool_or(score >= 0.6), false) as any_winner, bool_or(nav) as nav from s group by user_id)
    select user_id, round(veto_ratio, 6) as veto_ratio, any_winner, veto_ratio > 0.7 and n >= 5 and not any_winner and not nav as vetoed from g
""")
def vetoed_queries(spark: SparkSession, d: str) -> DataFrame:
    scores = read(spark, d, "events").where("event_type <> 'view'").select("user_id", (F.col("value") / 100).alias("score"), (F.col("user_id") % 5 == 0).alias("nav"))
    return A.collective_veto(scores, "user_id", "score", 0.6, "nav").withColumn("veto_ratio", F.round("veto_ratio", 6))


@query("""
    with q as (select o_custkey as q, any_value(o_custkey % 7 < 3) as nav from orders group by o_custkey),
    c as (select o_custkey as q, count(*) as n, max(o_totalprice / 100000) as best from orders group by o_custkey),
    r as (select q.q, n > 0 and (not nav or best < 1 or q.q % 11 = 0) and q.q % 3 <> 0 as run from q join c using (q))
    select q, run, case when run then 12 else 0 end as most, false as degraded from r
""")
def rerank_routes(spark: SparkSession, d: str) -> DataFrame:
    """Which customers' orders would be reranked: named look-ups only where scores are weak or flat, keyword searches never."""
    o, key = read(spark, d, "orders"), F.col("o_custkey")
    queries = o.select(key.alias("q")).distinct().select("q", F.lit("question").alias("text"), F.when(F.col("q") % 3 == 0, "keyword").otherwise("hybrid").alias("mode"), (F.col("q") % 7 < 3).alias("navigational"), F.lit(1).alias("text_hits"), F.when(F.col("q") % 11 == 0, 1.0).otherwise(2.0).alias("flatness"), F.lit(40).alias("rerank_top_k"), F.lit(10).alias("return_top_k"))
    candidates = o.select(key.alias("q"), (F.col("o_totalprice") / 100000).alias("es"), F.col("o_orderstatus").alias("doc_type"), F.col("o_orderpriority").alias("text"))
    return A.rerank_routes(queries, candidates, "q")


@query(f"""
    with r as ({ORACLE_SQL["evidence_ranking"]}),
    f as (select conv_id, min_by(text, turn) as text from conversations group by conv_id),
    t as (select conv_id % 20 as q, conv_id, rank_score, contains(text, 'that') or contains(text, 'nicht') as topical, row_number() over (partition by conv_id % 20 order by rank_score desc, conv_id) as rank from r join f using (conv_id)),
    k as (select *, bool_or(topical) over (partition by q) as found from t),
    p as (select *, row_number() over (partition by q order by rank) as place from k where topical or not found),
    e as (select *, max(case when place = 1 then rank_score end) over (partition by q) >= 2.0 as enough from p)
    select q, conv_id, place from e where place <= case when enough then 2 else 4 end
""")
def prompt_documents(spark: SparkSession, d: str) -> DataFrame:
    """Conversations that go into a prompt: topical ones, two where the best is enough, else four."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("chunk_index"), "text", (F.length("text") / 1000.0).alias("score"))
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    ranked = E.rank_evidence(c, TERMS, "conv_id").select("conv_id", F.round("rank_score", 6).alias("rank_score")).join(first, "conv_id").withColumn("q", F.col("conv_id") % 20)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rank_score"), "conv_id"))).withColumn("question", F.lit("that nicht 要求"))
    none = F.lit(0.0)
    ranked = ranked.withColumn("sufficient", A.sufficient(F.col("question"), F.lit(0), none, none, F.col("rank_score"), F.lit(1.0)))
    return A.select_for_prompt(ranked, "q", 2, 4).select("q", "conv_id", "place")
