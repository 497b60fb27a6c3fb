"""Ranking rules applied to whole tables: order lines stand for a query's candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import ranking as R
from foliant.operators import search as S
from foliant.sources.tables import read_table as read

from .registry import query
from .text import TOK


@query("""
    with p as (select p_partkey, p_size % 6 as hits, 1 + cast(p_size as double) / 10 as ratio, p_retailprice / 2000 as knn, p_size % 7 = 0 as nav, p_size % 3 as k from part),
    c as (select *, case when hits > 0 then least(0.2e0 + (ratio - 1) / 8 * 0.8e0, 1e0) else 0e0 end as t, greatest(0e0, least(1e0, knn)) as v from p)
    select p_partkey, round(case when nav then 0.7e0 when t + v < 0.2e0 then 0.3e0 * 0.4e0 else 0.3e0 * (t / (t + v) * 0.6e0 + 0.2e0) end, 6) as text_weight,
      round(case when nav then 0.3e0 when t + v < 0.2e0 then 0.7e0 * 0.6e0 else 0.7e0 * (v / (t + v) * 0.6e0 + 0.2e0) end, 6) as vector_weight, 0.06e0 as sparse_weight,
      round(0.7e0 * case k when 0 then 1.5e0 when 1 then 0.3e0 else 0.8e0 end, 6) as qa_weight, 2e0 as prefilter_weight from c
""")
def fusion_weights(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    intent = F.element_at(F.array(*map(F.lit, ("INFORMATIONAL", "NAVIGATIONAL", "UNKNOWN"))), (size % 3 + 1).cast("int"))
    w = R.channel_weights(size % 6, 1 + size / 10, F.col("p_retailprice") / 2000, size % 7 == 0, intent)
    rows = read(spark, d, "part").select("p_partkey", w.alias("w"))
    return rows.select("p_partkey", *(F.round(f"w.{c}", 6).alias(f"{c}_weight") for c in ("text", "vector", "sparse", "qa", "prefilter")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a query (an order): text, vector, fused and reranked scores made from a line's columns."""
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 20).alias("es"), (F.col("l_discount") * 5).alias("knn"), F.col("l_tax").alias("rrf"),
        (F.col("l_discount") * 10).alias("score"), (F.col("l_tax") * 10).alias("rerank"),
    )


_LINES = "c as (select l_orderkey, l_linenumber, l_quantity / 20 as es, l_discount * 5 as knn, l_tax as rrf, l_discount * 10 as score, l_tax * 10 as rerank from lineitem)"


@query(f"with {_LINES} select l_orderkey, l_linenumber, round(case when max(es) over (partition by l_orderkey) < 2 and knn < 0.15e0 then rrf * 0.05e0 else rrf end, 6) as rrf from c")
def weak_text_suppression(spark: SparkSession, d: str) -> DataFrame:
    return R.suppress_weak_text(_lines(spark, d), "l_orderkey").select("l_orderkey", "l_linenumber", F.round("rrf", 6).alias("rrf"))


@query(f"""
    with {_LINES}, w as (select *, max(score) over (partition by l_orderkey) as top, count(*) over (partition by l_orderkey) as n, max(rerank) over (partition by l_orderkey) as best from c)
    select l_orderkey, l_linenumber, round(score, 6) as score from w where not (n >= 5 and best < 0.6e0) and top >= 0.35e0 and (score >= greatest(top * 0.2e0, 0.15e0) or score >= 0.99e0)
""")
def surviving_candidates(spark: SparkSession, d: str) -> DataFrame:
    return R.surviving(_lines(spark, d), "l_orderkey").select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


_CONTENT = ("根据有关规定办理", "经会议研究决定", "现将名单予以公示", "特此通知", "正文内容")
_TYPES = ("公示", "通知", "通告", "法规", "")


@query(f"""
    with o as (select o_orderkey, ({list(_CONTENT)})[o_orderkey % 5 + 1] as content, ({list(_TYPES)})[o_custkey % 5 + 1] as kind, o_orderstatus = 'P' as flagged, case when o_orderstatus = 'O' then '' else '第一章' end as path from orders)
    select o_orderkey, case when flagged or (path = '' and content <> '正文内容') then case kind when '公示' then 0.25e0 when '通知' then 0.4e0 when '通告' then 0.4e0 else 0.55e0 end else 1e0 end as factor from o
""")
def preamble_demotion(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (F.col(key) % 5 + 1).cast("int"))
    path = F.when(F.col("o_orderstatus") == "O", "").otherwise("第一章")
    factor = R.preamble_factor(pick(_TYPES, "o_custkey"), F.col("o_orderstatus") == "P", path, pick(_CONTENT, "o_orderkey"))
    return read(spark, d, "orders").select("o_orderkey", factor.alias("factor"))


@query("""
    with c as (select l_orderkey, l_linenumber, l_linenumber = 7 as qa, case when l_returnflag = 'N' then null else l_quantity / 10 - 1 end as rr, l_quantity / 20 as es, l_discount * 10 as knn, l_tax as rrf from lineitem),
    r as (select *, es / (es + 150) as n, rr between 0 and 1 as plain, case when rr between 0 and 1 then rr else 1 / (1 + exp(-rr)) end as rel from c)
    select l_orderkey, l_linenumber, round(case when qa then 0.95e0 when rr is not null then case when rel < (case when plain then 0.6e0 else 0.1e0 end) then 0.0001e0 else rel * 0.9e0 + n * 0.1e0 end
      when es > 1 then greatest(n, rrf * 5) when knn >= 0.65e0 then knn * 0.7e0 else 0.0001e0 end, 6) as score from r
""")
def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    es = F.col("l_quantity") / 20
    rerank = F.when(F.col("l_returnflag") != "N", F.col("l_quantity") / 10 - 1)
    score = R.baseline_score(F.col("l_linenumber") == 7, rerank, es / (es + 150), es, F.col("l_discount") * 10, F.col("l_tax"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("""
    with c as (select l_orderkey, l_linenumber, l_tax as rrf, (['公示', '法规', '报告'])[l_orderkey % 3 + 1] as kind, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_extendedprice, l_tax) as r, count(*) over (partition by l_orderkey) as n, max(l_tax) over (partition by l_orderkey) as best from lineitem)
    select l_orderkey, l_linenumber, round(case when r = 1 and n > 1 and kind <> '报告' and best > 0 then greatest(rrf * 1.3e0, best * 0.9e0) else rrf end, 6) as rrf from c
""")
def density_boost(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("公示", "法规", "报告"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("density"), F.col("l_tax").alias("rrf"), kind.alias("doc_type"), F.struct("l_linenumber", "l_partkey", "l_extendedprice", "l_tax").alias("place"))
    return R.boost_densest(rows, "l_orderkey", "place").select("l_orderkey", "l_linenumber", F.round("rrf", 6).alias("rrf"))


@query(f"""
    with f as (select doc_id, {TOK} as t from documents), k as (select doc_id, len(list_filter(t, lambda x: x in ('that', 'hain', 'nicht', 'eaux'))) as n from f), m as (select max(n) as top from k)
    select doc_id, round(greatest(0.05e0, least(0.99e0, 0.5e0 + 0.49e0 * n / top)), 4) as score from k, m where n > 0
""")
def keyword_results(spark: SparkSession, d: str) -> DataFrame:
    counts = S.term_counts(F.col("text"), ["that", "hain", "nicht", "eaux"])
    k = read(spark, d, "documents").select("doc_id", F.aggregate(counts, F.lit(0), lambda s, x: s + x).alias("n"))
    top = k.agg(F.max("n").alias("top"))  # one row
    return k.where("n > 0").crossJoin(F.broadcast(top)).select("doc_id", R.shown_score(F.col("n"), F.col("top")).alias("score"))


@query(f"""
    with h as (select doc_id, unnest({TOK}) as token from documents), w as (select doc_id, token, cast(count(*) as double) as w from h group by all),
    m as (select *, median(w) over (partition by doc_id) as md, max(w) over (partition by doc_id) as top from w),
    s as (select doc_id, token, case when top > md then case when w >= md then 0.1e0 + 0.9e0 * (w - md) / (top - md) end else 0.5e0 end as x from m),
    r as (select doc_id, token, x, row_number() over (partition by doc_id order by x desc, token) as n from s where x > 0)
    select doc_id, token, round(x, 4) as weight from r where n <= 64
""")
def sparse_encoding(spark: SparkSession, d: str) -> DataFrame:
    return R.sparse_encoding(read(spark, d, "documents"))


@query("""
    with q as (select vec_id as q, cast(embedding as double[]) as v from embeddings where vec_id % 50 = 0),
    b as (select label, q, max(list_cosine_similarity(cast(embedding as double[]), v)) as best from embeddings, q group by label, q)
    select label, round(avg(best), 6) as score from b group by label
""")
def late_interaction(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a label stand for the tokens of a document; the query's tokens are the vectors whose id is divisible by 50."""
    e = read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return R.late_interaction(e, queries, "label").select("label", F.round("score", 6).alias("score"))
