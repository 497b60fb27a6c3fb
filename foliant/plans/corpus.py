"""Question answering and evidence over ``conversations`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import evidence as E
from foliant.sources.tables import read_table as read

from .registry import query
from .retrieval import _LIST, TERMS
from .text import TOK


@query("""
    with t as (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) as next_role, lead(text) over (partition by conv_id order by turn) as answer from conversations)
    select conv_id, turn, md5(text) as question, md5(answer) as answer from t where role = 'user' and next_role = 'assistant'
""")
def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return E.qa_pairs(read(spark, d, "conversations")).select("conv_id", "turn", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("""
    select conv_id, cast(count(*) as int) as hit_count, cast(max(length(text)) as double) as max_score, cast(sum(length(text)) as double) as sum_score, list(turn order by turn) as chunks from conversations group by conv_id
""")
def evidence_groups(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), F.length("text").cast("double").alias("score"))
    return E.group_evidence(c, "conv_id").select("conv_id", F.col("hit_count").cast("int"), "max_score", "sum_score", "chunks")


@query(f"""
    with t as (select conv_id, turn, list_distinct({TOK}) as toks, length(text) / 1000.0 as score from conversations),
    g as (select conv_id, count(*) as hits, max(score) as mx, sum(score) as sm, max(len(list_intersect(toks, [{_LIST}])) / 4.0) as cov from t group by conv_id),
    a as (select conv_id, sum(case when turn - p = 1 then 1 else 0 end) as adj from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as p from conversations) group by conv_id)
    select conv_id, round(1.5 * mx + ln(1 + sm) + 0.4 * hits + 2 * cov + 0.8 * adj, 6) as rank_score from g join a using (conv_id)
""")
def evidence_ranking(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("chunk_index"), "text", (F.length("text") / 1000.0).alias("score"))
    return E.rank_evidence(c, TERMS, "conv_id").select("conv_id", F.round("rank_score", 6).alias("rank_score"))


@query("""
    with n as (select conv_id, turn, role, length(text) as sz, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as used from conversations)
    select conv_id, turn, cast(least(sz, 1500 - used) as bigint) as take from n where least(sz, 1500 - used) = sz or 1500 - used >= 120
""")
def prompt_packing(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return E.pack(c, ["conv_id"], "turn", 1500).select("conv_id", "turn", "take")


@query(f"""
    with t as (select conv_id, turn, role, list_distinct({TOK}) as toks from conversations),
    u as (select conv_id, turn, toks as q, lead(toks) over (partition by conv_id order by turn) as a, role, lead(role) over (partition by conv_id order by turn) as nr from t)
    select conv_id, turn, round(len(list_intersect(q, a)) / greatest(len(q), 1), 6) as coverage, len(list_intersect(q, a)) / greatest(len(q), 1) >= 0.12 as sufficient from u where role = 'user' and nr = 'assistant'
""")
def evidence_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    p = E.qa_pairs(read(spark, d, "conversations"))
    cov = E.coverage(F.col("question"), F.col("answer"))
    return p.select("conv_id", "turn", F.round(cov, 6).alias("coverage"), (cov >= 0.12).alias("sufficient"))


@query("""
    select conv_id, turn, cast(len(list_distinct(regexp_extract_all(text, '[0-9]+'))) as int) as cited, cast(len(list_filter(list_distinct(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: try_cast(x as bigint))), lambda x: x is null or x < 1 or x > 3)) as int) as unknown
    from conversations where role = 'assistant'
""")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").where("role = 'assistant'")
    cited = F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)))
    return c.select("conv_id", "turn", F.size(cited).alias("cited"), F.size(E.unknown_citations(F.col("text"), 3, "[0-9]+", 0)).alias("unknown"))


@query("""
    with w as (select role, conv_id, turn, text, row_number() over (partition by conv_id order by turn desc) as rn from conversations)
    select conv_id, turn, role, length(text) as chars from w where rn <= 2
""")
def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return read(spark, d, "conversations").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("conv_id", "turn", "role", F.length("text").alias("chars"))


@query()
def coverage_selection(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn", "text", F.length("text").cast("double").alias("score"))
    return E.cover(c, TERMS, "conv_id")


@query()
def parent_links(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.chunking import linked_chunks

    return linked_chunks(read(spark, d, "documents"))


@query("""
    select item_id, doc_id from benchmark b join documents d on contains(lower(d.text), lower(b.text)) where length(b.text) > 3
""")
def literal_probe(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the whole text of an item, by hashes of their windows."""
    from foliant.operators.rolling import literal_matches

    items = read(spark, d, "benchmark").where(F.length("text") > 3).select("item_id", F.lower("text").alias("probe"))
    docs = read(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    return literal_matches(docs, items, "doc_id", "t", "item_id", "probe")


@query(f"""
    with s as (select doc_id, source, {TOK} as toks from documents)
    select source, count(*) as docs, max(len(toks)) as longest, round(avg(len(toks)), 6) as mean_tokens, sum(case when len(toks) > 512 then 1 else 0 end) as truncated, round(sum(case when len(toks) > 512 then 1 else 0 end) / count(*), 6) as truncated_ratio from s group by source
""")
def embedding_length_stats(spark: SparkSession, d: str) -> DataFrame:
    from foliant.functions.text import tokens

    n = F.size(tokens(F.col("text")))
    long = F.sum(F.when(n > 512, 1).otherwise(0))
    return read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.max(n).cast("long").alias("longest"), F.round(F.avg(n), 6).alias("mean_tokens"), long.alias("truncated"), F.round(long / F.count(F.lit(1)), 6).alias("truncated_ratio"))
