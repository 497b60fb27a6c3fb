"""Versions, reconciliation, sensitive terms, routing and batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import policy as P
from foliant.operators import quantiles as Q
from foliant.operators import versions as V
from foliant.sources.tables import read_table as read
from foliant.sources.tables import spread

from .registry import query

_ROWS = "select l_partkey as source, l_linenumber as doc_version, l_orderkey, l_linenumber from lineitem"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_linenumber").alias("doc_version"), "l_orderkey", "l_linenumber")


@query(f"with r as ({_ROWS}), c as (select source, max(doc_version) as v from r group by source) select r.source, doc_version, l_orderkey, l_linenumber, doc_version = v as is_latest from r join c using (source)")
def version_switch(spark: SparkSession, d: str) -> DataFrame:
    r = _rows(spark, d)
    return V.switch_latest(r, V.current_versions(r))


@query(f"select source, max(doc_version) + 1 as next_version from ({_ROWS}) group by source")
def next_versions(spark: SparkSession, d: str) -> DataFrame:
    return V.next_versions(_rows(spark, d))


@query("""
    with s as (select c_custkey as k, c_custkey % 5 as v from customer), t as (select distinct o_custkey as k, o_custkey % 4 as v from orders union all select 1000000, 0)
    select coalesce(s.k, t.k) as k, case when t.v is null then 'missing' when s.v is null then 'orphan' when t.v < s.v then 'stale' else 'ok' end as state from s full join t on s.k = t.k
""")
def reconcile_documents(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 5).alias("v"))
    t = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_custkey") % 4).alias("v")).distinct()
    t = t.unionByName(spark.createDataFrame([(1000000, 0)], "k long, v long"))
    return V.reconcile(s, t, "k", "v")


@query(f"with r as (select *, l_orderkey % 4 = 0 as is_latest from ({_ROWS})) select source, max(doc_version) as repair_to from r group by source having not bool_or(is_latest)")
def stuck_versions(spark: SparkSession, d: str) -> DataFrame:
    return V.stuck(_rows(spark, d).withColumn("is_latest", F.col("l_orderkey") % 4 == 0))


@query("""
    select p_partkey, case when ps is not null then 'changed' else p_name end as name from part left join (select distinct l_partkey as ps from lineitem where l_quantity > 45) on p_partkey = ps
""")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    changes = read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), F.lit("changed").alias("name")).distinct()
    return V.upsert(table, changes, ["p_partkey"])


@query("""
    select c_custkey, coalesce(o1, o2) as owner from customer left join (select s_suppkey, s_name as o1 from supplier where s_suppkey % 2 = 0) on c_custkey = s_suppkey
      left join (select n_nationkey, n_name as o2 from nation) on c_nationkey = n_nationkey
""")
def owner_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("source"))
    by_id = read(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("owner"))
    by_source = read(spark, d, "nation").select(F.col("n_nationkey").alias("source"), F.col("n_name").alias("owner"))
    return V.owners(rows, by_id, by_source).select(F.col("doc_id").alias("c_custkey"), "owner")


@query("""
    select conv_id, cast(max(turn) as bigint) as doc_version, count(*) as chunks, list_transform(list_slice(list({'t': turn, 'x': text} order by turn, text), 1, 3), lambda s: substring(s.x, 1, 500)) as summaries,
      list_slice(list_sort(list(distinct turn)), 1, 32) as chunk_ids, list_sort(list(distinct role)) as tokens from conversations group by conv_id
""")
def document_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", F.col("turn").alias("seq"), F.col("text").alias("content"), F.col("turn").alias("doc_version"), F.array("role").alias("tokens"))
    return V.rollup(c, "conv_id")


@query("""
    with t as (select p_partkey, string_split(p_type, ' ')[1] as tag from part), r as (select n_name, n_nationkey from nation where n_nationkey < 3)
    select p_partkey, tag, case when tag = 'SMALL' then 'kb_small' when tag = 'LARGE' then 'kb_large' else 'kb_default' end as target from t
""")
def tag_routing(spark: SparkSession, d: str) -> DataFrame:
    routes = spark.createDataFrame([("SMALL", "kb_small"), ("LARGE", "kb_large")], "tag string, target string")
    return P.route(read(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("tag")), routes, "tag", "kb_default")


@query("""
    with p(id, word, repl) as (values (1, 'that', '***'), (2, 'idiot', '[X]')),
    h as (select doc_id, sum(least(1000, len(string_split(case id when 1 then replace(replace(text, 'idiot', '[X]'), 't', 'tt') else text end, word)) - 1)) as hits from documents, p group by doc_id)
    select doc_id, cast(hits as bigint) as hits, md5(replace(replace(text, 'idiot', '[X]'), 'that', '***')) as masked_md5 from documents join h using (doc_id)
""")
def sensitive_masking(spark: SparkSession, d: str) -> DataFrame:
    rules = [P.Policy(1, "WORD", "that", "MASK", "***", priority=1), P.Policy(2, "WORD", "idiot", "MASK", "[X]", priority=5)]
    return read(spark, d, "documents").select("doc_id", P.apply_policies(rules)("text").alias("r")).select("doc_id", F.col("r.hits").alias("hits"), F.md5("r.text").alias("masked_md5"))


@query(r"""
    with recursive w as (select word, len(list_filter(range(1, length(word)), lambda k: word[1 : k] = word[length(word) - k + 1 :])) > 0 as own
      from (select distinct unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) as word from benchmark)),
    c as (select row_number() over () as i, doc_id, word, own, text from documents, w where contains(text, word)),
    o as (select i, word, text as rest from c where own union all select i, word, substr(rest, strpos(rest, word) + 1) from o where contains(substr(rest, strpos(rest, word) + 1), word)),
    n as (select i, count(*) as n from o group by i)
    select doc_id, word, least(1000, case when own then n else len(string_split(text, word)) - 1 end) as hits from c left join n using (i)
""")
def policy_word_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of every longer word of ``benchmark`` in ``documents``, all words in one pass over a text."""
    words = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), 0)).alias("w")).distinct()
    listed = [r["w"] for r in words.orderBy("w").limit(P.MOST_WORDS + 1).collect()]
    if len(listed) > P.MOST_WORDS:
        raise ValueError(f"a list of words holds at most {P.MOST_WORDS}")
    return P.word_counts(spread(read(spark, d, "documents")), listed, "doc_id", "text")


@query("""
    select doc_id, contains(text, 'idiot') or contains(text, 'moron') as blocked from documents
""")
def sensitive_blocking(spark: SparkSession, d: str) -> DataFrame:
    rules = [P.Policy(1, "WORD", "idiot", "BLOCK_QA"), P.Policy(2, "REGEX", "mor[o]n", "BLOCK_QA")]
    blocked = P.apply_policies(rules)("text")["blocked"]
    return read(spark, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), blocked).alias("blocked"))


@query("""
    with b as (select o_custkey as batch, o_orderstatus as s from orders)
    select batch, count(*) as total, count(*) filter (s = 'F') as done, count(*) filter (s = 'O') as pending, count(*) filter (s = 'P') as failed, round(100.0 * count(*) filter (s = 'F') / count(*), 4) as pct from b group by batch
""")
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count(F.lit(1)).alias("total"), n("F").alias("done"), n("O").alias("pending"), n("P").alias("failed"), F.round(100.0 * n("F") / F.count(F.lit(1)), 4).alias("pct"))


@query("""
    with p as (select page_id, page_id // 5 as doc, case when length(html) % 7 = 0 then 'FAILED' else 'SUCCESS' end as status from pages),
    c as (select doc as doc_id, sum(case when status = 'SUCCESS' then 1 else 0 end) / count(*) as coverage from p group by doc)
    select doc_id, round(coverage, 6) as coverage, case when coverage < 0.5 then 'ERROR' when coverage < 0.98 then 'PARTIAL' else 'OK' end as gate from c
""")
def parse_coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.cleaning import parse_gate

    p = read(spark, d, "pages").select(F.floor(F.col("page_id") / 5).alias("doc_id"), F.when(F.length("html") % 7 == 0, "FAILED").otherwise("SUCCESS").alias("status"))
    return parse_gate(p).withColumn("coverage", F.round("coverage", 6))


@query("""
    select page_id from pages where url is null or url = '' or regexp_matches(url, '%[0-9A-Fa-f]{2}') or page_id % 9 = 4
""")
def projection_gaps(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.policy import missing_any

    gap = F.when(F.col("page_id") % 9 == 4, "").otherwise(F.col("url"))
    return read(spark, d, "pages").where(missing_any(gap) | F.col("url").rlike("%[0-9A-Fa-f]{2}")).select("page_id")


@query("""
    with d as (select doc_id, n_chars from documents), s as (select list_sort(list(n_chars)) as v, count(*) as n, avg(n_chars) as a from d)
    select n, v[cast(round_even((n - 1) * 0.5, 0) as int) + 1] as p50, v[cast(round_even((n - 1) * 0.95, 0) as int) + 1] as p95, v[cast(round_even((n - 1) * 0.99, 0) as int) + 1] as p99,
      cast(ceil(a * 100000000 / (30.0 * 1024 * 1024 * 1024)) as bigint) as shards_30gb from s
""")
def capacity_audit(spark: SparkSession, d: str) -> DataFrame:
    """Order statistics by nearest rank, selected by range counts."""
    docs = read(spark, d, "documents").select("n_chars")
    at = {name: Q.nearest_rank(p) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
    found = Q.select_positions(docs, [], "n_chars", at)
    return found.crossJoin(F.broadcast(docs.agg(F.ceil(F.coalesce(F.avg("n_chars"), F.lit(0.0)) * 100000000 / (30.0 * 1024**3)).cast("long").alias("shards_30gb"))))  # one row


@query("""
    with e as (select event_id, user_id, ts, value, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, count(*) over (partition by user_id) as versions from events)
    select user_id, event_id, value, versions from e where rn = 1
""")
def latest_state_per_key(spark: SparkSession, d: str) -> DataFrame:
    """As-of state of an append-only log: one aggregate, no window over hot keys."""
    e = read(spark, d, "events")
    best = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(best.alias("b"), F.count(F.lit(1)).alias("versions")).select("user_id", "b.*", "versions")


@query("""
    select o_orderkey, take from (select o_orderkey, o_custkey, sz, used, least(sz, 4000 - used) as take from (
      select o_orderkey, o_custkey, sz, coalesce(sum(sz) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) as used from (select o_orderkey, o_custkey, cast(o_totalprice as bigint) // 100 as sz from orders))) where take = sz or take > 50
""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor(F.round("o_totalprice") / 100).cast("long").alias("sz"))
    return V.budget_prefix(o, ["o_custkey"], [F.asc("o_orderkey")], F.col("sz"), 4000).select("o_orderkey", "take")
