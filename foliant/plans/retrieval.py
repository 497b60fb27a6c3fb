"""Search: keyword, vector, sparse and hybrid retrieval, ranking and collapsing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import search as S
from foliant.operators.cosines import by_blocks, nearest_elsewhere
from foliant.sources.tables import read_table as read
from foliant.sources.tables import spread

from .registry import query
from .text import TOK

TERMS = ["that", "hain", "nicht", "eaux"]
_LIST = ", ".join(f"'{t}'" for t in TERMS)
_IN = f"({_LIST})"

BM25_SQL = f"""
    d as (select doc_id, {TOK} as toks from documents),
    st as (select count(*) as n_docs, avg(len(toks)) as avg_len from d),
    h as (select doc_id, len(toks) as l, unnest(toks) as term from d),
    tf as (select doc_id, term, count(*) as tf, any_value(l) as l from h where term in {_IN} group by doc_id, term),
    df as (select term, count(*) as df from tf group by term),
    bm as (select doc_id, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) as score
           from tf join df using (term), st group by doc_id)"""


@query(rf"""
    with s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as x from documents),
    c as (select doc_id, trim(x) as x from s where length(trim(x)) >= 20),
    t as (select doc_id, x, list_filter(string_split_regex(lower(x), '[^a-z0-9]+'), lambda t: t <> '') as toks from c),
    st as (select count(*) as n_docs, avg(len(toks)) as avg_len from t),
    u as (select doc_id, x, toks, row_number() over (order by doc_id, x) as rid from (select distinct doc_id, x, toks from t)),
    cnt as (select doc_id, x, count(*) as copies from t group by doc_id, x),
    h as (select u.doc_id, u.rid, len(toks) as l, unnest(toks) as term from u),
    tf as (select doc_id, rid, term, count(*) as tf, any_value(l) as l from h where term in {_IN} group by all),
    dfc as (select tf.term, sum(copies) as df from tf join u using (rid) join cnt on cnt.doc_id = u.doc_id and cnt.x = u.x group by tf.term),
    bm as (select doc_id, rid, sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))) as score from tf join dfc using (term), st group by doc_id, rid)
    select doc_id, round(max(score), 6) as best, count(*) as passages from bm group by doc_id order by round(max(score), 6) desc, doc_id limit 10
""")
def search_clean_chunk_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: split documents into sentence passages, score them by BM25, keep the best documents."""
    passages = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: F.length(x) >= 20)
    docs = spread(read(spark, d, "documents").select("doc_id", "text")).select("doc_id", passages.alias("p"))
    counted = lambda p: docs.select("doc_id", F.explode(p).alias("x")).select("doc_id", S.token_count(F.col("x")).alias("len"), S.term_counts(F.col("x"), TERMS).alias("tf"))
    # every passage counts in the statistics; a passage that a document repeats is scored once
    hits = counted(F.array_distinct("p")).where(F.exists("tf", lambda f: f > 0))
    scored = hits.crossJoin(F.broadcast(S.bm25_stats(counted(F.col("p")), TERMS))).select("doc_id", S.bm25_score().alias("score"))
    best = scored.groupBy("doc_id").agg(F.round(F.max("score"), 6).alias("best"), F.count(F.lit(1)).alias("passages"))
    return best.orderBy(F.desc("best"), "doc_id").limit(10)


@query(f"with {BM25_SQL} select doc_id, round(score, 6) as score from bm order by round(score, 6) desc, doc_id limit 60")
def bm25_top60(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25(read(spark, d, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(60)


@query(f"""
    with h as (select doc_id, unnest({TOK}) as term from documents)
    select doc_id, term, count(*) as tf from h where term in {_IN} group by doc_id, term
""")
def postings_of_terms(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(read(spark, d, "documents"), terms=TERMS)


@query(f"""
    with h as (select doc_id, unnest({TOK}) as term from documents)
    select term, count(distinct doc_id) as df, count(*) as cf from h group by term having count(distinct doc_id) >= 5
""")
def document_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return S.document_frequencies(read(spark, d, "documents")).where("df >= 5")


@query(f"""
    with h as (select distinct doc_id, unnest({TOK}) as term from documents)
    select doc_id from h where term in ('the', 'that') group by doc_id having count(*) = 2
""")
def keyword_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return S.hold_all_terms(read(spark, d, "documents"), ["the", "that"])


@query(f"""
    with h as (select doc_id, {TOK} as t from documents), f as (select doc_id, len(t) as l, list_distinct(t) as u, t from h)
    select doc_id, round(coverage, 6) as coverage, round(5 * coverage + case when coverage = 1 then 8 else 0 end + tf / (tf + 10.0), 6) as rank_score from (
      select doc_id, len(list_intersect(u, [{_LIST}])) / 4.0 as coverage, len(list_filter(t, lambda x: list_contains([{_LIST}], x))) as tf from f)
    where coverage > 0
""")
def keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(t) for t in TERMS])
    t = read(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    tf = F.size(F.filter("t", lambda x: x.isin(*TERMS)))
    hit = t.select("doc_id", (F.size(F.array_intersect("t", q)) / 4.0).alias("coverage"), tf.alias("tf")).where("coverage > 0")
    best = F.col("tf") / (F.col("tf") + 10.0)
    return hit.select("doc_id", F.round("coverage", 6).alias("coverage"), F.round(S.keyword_rank(best, F.col("coverage"), F.col("coverage") == 1, F.lit(0)), 6).alias("rank_score"))


_Q = "(select embedding from embeddings where vec_id = 7)"
_COS = "list_cosine_similarity(cast(embedding as double[]), cast(q as double[]))"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    found = read(spark, d, "embeddings").where("vec_id = 7").select("embedding").first()
    return [float(x) for x in found[0]] if found else [0.0]


@query(f"select vec_id, round(score, 6) as score, cast(row_number() over (order by round(score, 6) desc, vec_id) as int) as rank from (select vec_id, {_COS} as score from embeddings, (select {_Q} as q)) order by 2 desc, 1 limit 50")
def knn_top50(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _query_vector(spark, d)])
    scored = read(spark, d, "embeddings").select("vec_id", F.round(S.cosine(F.col("embedding"), q), 6).alias("score"))
    return S.top_k(scored, 50, "vec_id")


@query(f"select vec_id, round({_COS}, 6) as score from embeddings, (select {_Q} as q) where label in (1, 2, 3) and {_COS} >= 0.15 order by round({_COS}, 6) desc, vec_id limit 20")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _query_vector(spark, d)])
    cos = S.cosine(F.col("embedding"), q)
    hit = read(spark, d, "embeddings").where(F.col("label").isin(1, 2, 3)).select("vec_id", cos.alias("score")).where("score >= 0.15")
    return hit.select("vec_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"""
    select bin, count(*) as n from (select cast(greatest(0, least(4, trunc({_COS} * 5))) as int) as bin from embeddings, (select {_Q} as q)) group by bin
""")
def corpus_scan_histogram(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _query_vector(spark, d)])
    return S.cosine_histogram(read(spark, d, "embeddings").select(S.cosine(F.col("embedding"), q).alias("score")))


@query(f"""
    select label, case when s >= 0.85 then 'HIGH' when s >= 0.70 then 'MEDIUM' when s >= 0.55 then 'LOW' else 'NONE' end as band, count(*) as n
    from (select label, {_COS} as s from embeddings, (select {_Q} as q)) group by all
""")
def similarity_bands(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _query_vector(spark, d)])
    e = read(spark, d, "embeddings").select("label", S.similarity_label(S.cosine(F.col("embedding"), q)).alias("band"))
    return e.groupBy("label", "band").agg(F.count(F.lit(1)).alias("n"))


_POOL = """
    with x as (select label, i, avg(cast(embedding[i] as double)) as m from (select label, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings) group by label, i),
    n as (select label, sqrt(sum(m * m)) as norm from x group by label)"""


@query(f"{_POOL} select label, list(round(m / norm, 6) order by i) as vector from x join n using (label) group by label")
def doc_vectors_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    pooled = S.mean_pool(read(spark, d, "embeddings"), "label")
    return pooled.select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("""
    select label, list(round(m, 6) order by i) as max_vector from (
      select label, i, max(cast(embedding[i] as double)) as m from (select label, embedding, unnest(generate_series(1, len(embedding))) as i from embeddings) group by label, i) group by label
""")
def doc_vectors_max_pool(spark: SparkSession, d: str) -> DataFrame:
    m = read(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.max(F.col("x").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: F.round(s["m"], 6)).alias("max_vector"))


@query("""
    select coalesce(reason, 'ok') as reason, count(*) as n from (
      select case when len(embedding) <> 64 then 'dense_vector_dim_mismatch' when len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 'dense_vector_invalid_value'
             when sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) <= 1e-8 then 'dense_vector_zero_norm' end as reason from embeddings) group by 1
""")
def vector_quality_gate(spark: SparkSession, d: str) -> DataFrame:
    reason = F.coalesce(S.vector_gate(F.col("embedding"), 64), F.lit("ok"))
    return read(spark, d, "embeddings").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_RRF = f"""
    with {BM25_SQL}, tx as (select doc_id, row_number() over (order by round(score, 6) desc, doc_id) as rank from bm qualify rank <= 100),
    kn as (select vec_id as doc_id, {_COS} as s from embeddings, (select {_Q} as q)),
    kr as (select doc_id, row_number() over (order by round(s, 6) desc, doc_id) as rank from kn where round(s, 6) >= 0.15 qualify rank <= 100),
    u as (select doc_id, rank, 'text' as c, 0.3 as w from tx union all select doc_id, rank, 'vector', 0.7 from kr),
    f as (select doc_id, sum(w / (60 + rank)) as rrf, list_sort(list(distinct c)) as channels from u group by doc_id)"""


def _channels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    text = S.bm25(read(spark, d, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score"))
    q = F.array(*[F.lit(x) for x in _query_vector(spark, d)])
    vec = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.round(S.cosine(F.col("embedding"), q), 6).alias("score")).where("score >= 0.15")
    return S.top_k(text, 100), S.top_k(vec, 100)


@query(f"{_RRF} select doc_id, round(rrf, 8) as rrf, channels from f")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    text, vec = _channels(spark, d)
    return S.fuse({"text": (text, 0.3), "vector": (vec, 0.7)}).select("doc_id", F.round("rrf", 8).alias("rrf"), "channels")


@query(f"""
    {_RRF}, s as (select f.doc_id, f.rrf, coalesce(round(bm.score, 6), 0) as es, coalesce(case when kr.doc_id is not null then round(kn.s, 6) end, 0) as knn
      from f left join bm on bm.doc_id = f.doc_id left join kn on kn.doc_id = f.doc_id left join kr on kr.doc_id = f.doc_id),
    sc as (select doc_id, rrf, knn, greatest(case when knn > 0 then greatest(knn, es / (es + 150)) else es / (es + 150) end, 0.0, rrf * 10) as score from s where not (knn < 0.15 and rrf < 0.005))
    select doc_id, round(score, 6) as score, round(least(0.99, greatest(0.05, pow(score, 1.8))), 6) as shown from sc
    where score >= greatest(0.2 * (select max(score) from sc), 0.06)
""")
def hybrid_final_scores(spark: SparkSession, d: str) -> DataFrame:
    text, vec = _channels(spark, d)
    fused = S.fuse({"text": (text, 0.3), "vector": (vec, 0.7)})
    all_text = S.bm25(read(spark, d, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("es"))
    s = fused.join(all_text, "doc_id", "left").join(vec.select("doc_id", F.col("score").alias("knn")), "doc_id", "left").na.fill(0.0, ["es", "knn"])
    sc = s.where(~((F.col("knn") < 0.15) & (F.col("rrf") < 0.005))).select("doc_id", S.final_score(F.col("es"), F.col("knn"), F.lit(0.0), F.col("rrf")).alias("score"))
    top = sc.agg(F.max("score").alias("top"))
    kept = sc.crossJoin(F.broadcast(top)).where("score >= greatest(0.2 * top, 0.06)")
    return kept.select("doc_id", F.round("score", 6).alias("score"), F.round(S.compressed(F.col("score")), 6).alias("shown"))


@query("""
    with w as (select l_orderkey, l_linenumber, l_extendedprice as score, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) as nth,
               max(l_extendedprice) over (partition by l_orderkey) as doc_score from lineitem)
    select l_orderkey, l_linenumber, score, doc_score, cast(nth as int) as nth from w where nth <= 3
""")
def collapse_best_chunks(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score"))
    return S.collapse(hits, "l_orderkey", order=[F.desc("score"), F.asc("l_linenumber")], most=3).select("l_orderkey", "l_linenumber", "score", "doc_score", "nth")


@query("""
    with o as (select o_orderkey, o_custkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as pos from orders qualify pos <= 60),
    n as (select *, row_number() over (partition by o_custkey order by pos) as nth from o),
    q as (select o_orderkey, o_custkey, cast(row_number() over (order by nth > 1, pos) as int) as place from n)
    select * from q where place <= 30
""")
def diversity_selection(spark: SparkSession, d: str) -> DataFrame:
    top = S.top_k(read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("score")), 60, "o_orderkey")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("rank"))
    ranked = top.withColumn("nth", nth).withColumn("place", F.row_number().over(Window.orderBy(F.col("nth") > 1, "rank")))  # sixty rows
    return ranked.where("place <= 30").select("o_orderkey", "o_custkey", "place")


@query(f"""
    with f as (select doc_id, term, count(*) as weight from (select doc_id, unnest({TOK}) as term from documents) where length(term) >= 4 group by all)
    select doc_id, round(sum(weight / (weight + case term when 'that' then 3.0 when 'hain' then 2.0 when 'nicht' then 1.5 else 1.0 end)), 6) as score from f where term in {_IN} group by doc_id
""")
def sparse_recall(spark: SparkSession, d: str) -> DataFrame:
    f = S.postings(read(spark, d, "documents"), terms=TERMS).where(F.length("term") >= 4).withColumnsRenamed({"term": "token", "tf": "weight"})
    return S.sparse_scores(f, {"that": 3.0, "hain": 2.0, "nicht": 1.5, "eaux": 1.0}).select("doc_id", F.round("score", 6).alias("score"))


@query("""
    select d1.doc_id, d2.doc_id as duplicate_of from (select doc_id, source, sha256(substring(text, 1, 2000)) as h from documents) d1
    join (select doc_id, source, sha256(substring(text, 1, 2000)) as h from documents) d2 on d1.h = d2.h and d1.source <> d2.source and d1.doc_id > d2.doc_id
    qualify row_number() over (partition by d1.doc_id order by d2.doc_id) = 1
""")
def duplicate_content(spark: SparkSession, d: str) -> DataFrame:
    """The first document of another source with the same content hash: from one aggregate a hash, not from pairs."""
    docs = read(spark, d, "documents").select("doc_id", "source", F.sha2(F.substring("text", 1, 2000), 256).alias("h"))
    firsts = docs.groupBy("h", "source").agg(F.min("doc_id").alias("first"))
    two = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("h").orderBy("first"))).where("nth <= 2")  # one row a hash and source
    two = two.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("first", "source"))).alias("two")).where(F.size("two") > 1)
    first, second = F.col("two")[0], F.col("two")[1]
    of = F.when(F.col("source") != first["source"], first["first"]).otherwise(second["first"])
    return docs.join(two, "h").select("doc_id", of.alias("duplicate_of")).where("duplicate_of < doc_id")


#: Query vectors broadcast at once.
QUERY_BLOCK = 1_000


@query()
def similar_documents(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 50 its nearest neighbours of another label by cosine."""
    return nearest_of_other_labels(read(spark, d, "embeddings").select("vec_id", "label", "embedding"))


def nearest_of_other_labels(e: DataFrame, every: int = 50, k: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): exact; queries go out in blocks of about ``QUERY_BLOCK``, each against all rows.

    Every task keeps the best ``k`` of a query before rows move.
    """
    queries = e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"), F.col("embedding").alias("qv"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answer(rows: DataFrame, asked: pa.Table) -> DataFrame:
        return nearest_elsewhere(rows, asked, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    found = by_blocks(e, queries, "query_id", QUERY_BLOCK, "nearest-elsewhere", answer)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))
