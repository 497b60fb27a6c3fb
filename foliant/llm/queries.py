"""The thin queries that ``__spark_entry__`` registers: operators applied to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import fit_and_score

    return fit_and_score(read(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch_path
    from .warc import fields, read_archive, reconstruct, write_archive

    path = scratch_path(spark, "archive")
    write_archive(read(spark, sf_dir, "pages"), path)
    records = fields(reconstruct(*read_archive(spark, path)))
    return records.select(F.col("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit_model, identify

    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit_model(docs))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_model, score_toxicity

    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_model(docs, read(spark, sf_dir, "labels")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"), count_links=True)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(read(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(read(spark, sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents")).drop("source", "repeats")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import document_manifest

    return document_manifest(read(spark, sf_dir, "documents"))[1]


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine_negatives

    rows = read(spark, sf_dir, "embeddings")
    return mine_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_warc, op3_language_id, op4_toxicity, op5_ngram_jaccard, op6_pii, op7_sharding, op8_nearest, op9_decontamination, op10_mixing, op11_merkle_manifest, op12_top_k, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        with p as (select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
        o as (select d, min(page_id) as owner from p group by d)
        select page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest,
               case when n < 100 or page_id = owner then 'response' else 'revisit' end as record_type,
               case when n < 100 or page_id = owner then null else owner end as refers_to
        from p join o on p.d = o.d
    """,
    "op5_ngram_jaccard": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as g from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) as i from w where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
        l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
        e as (select a, b from l union all select b, a from l),
        d as (select a as doc_id, count(*) as n_links from e group by a),
        r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on r.other = e.a)
        select r.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(other) as component_id, coalesce(any_value(d.n_links), 0) as n_links
        from r left join n on n.doc_id = r.doc_id left join d on d.doc_id = r.doc_id group by r.doc_id
    """,
    "op9_decontamination": r"""
        with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        bw as (select distinct item, list_slice(w, i, i + 9) as g from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
        sizes as (select distinct len(g) as k from bw),
        dw as (select rid, p, k, list_slice(w, p, p + k - 1) as g from (select rid, w, k, unnest(generate_series(1, len(w) - k + 1)) as p from d, sizes where len(w) >= k)),
        m as (select rid, item, p, k from dw join bw using (g)),
        h as (select rid, count(distinct pos) as n_hit from (select rid, unnest(generate_series(p, p + k - 1)) as pos from m) group by rid),
        t as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by rid)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join h using (rid) left join t using (rid)
    """,
    "op11_merkle_manifest": r"""
        with recursive d as (
            select *, (select list_reduce([ord(c) for c in string_split(cast(doc_id as varchar), '')],
                lambda h, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end, xor(h, b)), 4294967295)) as crc from documents),
        f as (select doc_id, lang, n_chars is not null and xor(crc, 4294967295) % 7 = 0 as forge,
                coalesce(strlen(cast(doc_id as varchar)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
                coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as n, strlen(cast(n_chars + 1 as varchar)) || ':' || (n_chars + 1) as more, coalesce(strlen(text) || ':' || text, '-') as body from d),
        h as (select doc_id, lang, sha256(head || n || body) as leaf, case when forge then sha256(head || more || body) end as forged from f),
        a as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from h),
        t as (select lang, 0 as lvl, i, leaf as h, n from a
              union all select lang, any_value(lvl) + 1, i // 2, sha256(string_agg(h, '' order by i)), any_value((n + 1) // 2) from t where n > 1 group by lang, i // 2),
        s as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from t where n = 1),
        u as (select 0 as lvl, i, subroot as h, n from s
              union all select any_value(lvl) + 1, i // 2, sha256(string_agg(h, '' order by i)), any_value((n + 1) // 2) from u where n > 1 group by i // 2),
        p as (select a.lang, a.i, string_agg(t.h, '' order by t.lvl) as proof from a join t on t.lang is not distinct from a.lang and t.i = xor(a.i >> t.lvl, 1) group by a.lang, a.i),
        q as (select s.lang, string_agg(u.h, '' order by u.lvl) as proof from s join u on u.i = xor(s.i >> u.lvl, 1) group by s.lang),
        g as (select lang, i, 0 as lvl, i as at, n, coalesce(forged, leaf) as h from a
              union all select g.lang, g.i, g.lvl + 1, g.at // 2, (g.n + 1) // 2, sha256(case when g.at % 2 = 1 then coalesce(t.h, '') || g.h else g.h || coalesce(t.h, '') end)
              from g left join t on t.lang is not distinct from g.lang and t.lvl = g.lvl and t.i = xor(g.at, 1) where g.n > 1),
        k as (select g.lang, g.i, 0 as lvl, s.i as at, s.n, g.h from g join s on s.lang is not distinct from g.lang where g.n = 1
              union all select k.lang, k.i, k.lvl + 1, k.at // 2, (k.n + 1) // 2, sha256(case when k.at % 2 = 1 then coalesce(u.h, '') || k.h else k.h || coalesce(u.h, '') end)
              from k left join u on u.lvl = k.lvl and u.i = xor(k.at, 1) where k.n > 1)
        select a.doc_id, a.leaf, s.subroot, u.h as root, sha256(coalesce(p.proof, '') || coalesce(q.proof, '')) as proof_sha256, k.h as folded_root, k.h = u.h as verified
        from a join s on s.lang is not distinct from a.lang join (select h from u where n = 1) u on true
        join k on k.lang is not distinct from a.lang and k.i = a.i and k.n = 1
        left join p on p.lang is not distinct from a.lang and p.i = a.i left join q on q.lang is not distinct from a.lang
    """,
    "op12_top_k": """
        with s as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        m as (select len(v) as d from s group by len(v) order by count(*) desc, d limit 1),
        r as (select s.* from s join m on len(v) = d),
        p as (select q.rid, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score from r q join r c on q.rid <> c.rid where q.vec_id % 50 = 0)
        select query_id, cast(rank as integer) as rank, vec_id, score from (select *, row_number() over (partition by rid order by score desc, vec_id nulls last) as rank from p) where rank <= 5
    """,
    "op13_hard_negatives": """
        with s as (select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
                   from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        m as (select len(v) as d from s group by len(v) order by count(*) desc, d limit 1),
        r as (select s.* from s join m on len(v) = d),
        p as (select a.rid, a.vec_id as anchor_id, c.rid as other, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.v, c.v) as bigint) as score from r a join r c on a.rid <> c.rid where a.vec_id % 50 = 0),
        g as (select * from (select *, row_number() over (partition by rid order by score desc, vec_id nulls last) as nth from p where same) where nth <= 5),
        n as (select g.anchor_id, g.vec_id as positive_id, p.vec_id as negative_id, g.score as positive_score, p.score as negative_score,
                     row_number() over (partition by g.rid, g.other order by p.score desc, p.vec_id nulls last) as rank
              from g join p on g.rid = p.rid and not p.same and 50 * g.score <= 100 * p.score and 100 * p.score <= 95 * g.score)
        select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
    """,
}
