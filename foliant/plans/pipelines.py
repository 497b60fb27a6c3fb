"""Structure of documents, terms, histories of rights, batches written once, and rows of growing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import headings as D
from foliant.operators import history as H
from foliant.operators import migrations as B
from foliant.operators import mining as M
from foliant.operators import pages as G
from foliant.operators import quantiles as Q
from foliant.sources import increments, ledger
from foliant.sources.scratch import shared_dir
from foliant.sources.tables import read_table as read
from foliant.sources.tables import spread

from .registry import query
from .streams import _drained


def _fresh(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


@query()
def document_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every document under their heading paths; tested by hand-worked documents."""
    return D.document_blocks(read(spark, d, "documents")).select("doc_id", "n", "kind", "path", F.md5("content").alias("content_md5"))


@query()
def page_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every page's outline with the titles above them; tested by hand-worked pages."""
    from foliant.sources.parsers import html_markdown

    lines = read(spark, d, "pages").select("page_id", F.posexplode(F.split(html_markdown("html"), "\n")).alias("n", "line"))
    rows = lines.withColumn("kind", F.when(F.col("line").startswith("#"), "title").otherwise("text"))
    return D.element_contexts(rows, "page_id", "n", "line", "kind").select("page_id", "n", F.md5("line").alias("line_md5"), "context")


@query("""
    with l as (select doc_id, regexp_replace(lower(text), '[^a-z]', '', 'g') as s, trim(text) as whole from documents),
    u as (select doc_id, s, n, s[1:n] as unit, ceil(length(s) * 0.8 / n) * n as need from l, (values (2), (3), (4), (5), (6), (7), (8)) v(n) where length(s) >= 4 and n <= length(s) // 2),
    r as (select doc_id, min(n) as n from u where need <= length(s) and s[n + 1 : need] = s[1 : need - n] group by doc_id),
    x as (select doc_id, k, o, regexp_extract_all(s[o + 1 :], repeat('.', k)) as x from l, (values (4, 0), (4, 1), (4, 2), (4, 3), (3, 0), (3, 1), (3, 2), (2, 0), (2, 1)) v(k, o) where length(s) >= k + o),
    g as (select doc_id, k, unnest(x) as term, o + k * unnest(range(len(x))) as i from x),
    c as (select doc_id, term, any_value(k) as k, count(*) as n, min(i) as first from g group by doc_id, term),
    m as (select doc_id, term, row_number() over (partition by doc_id order by n desc, k desc, first) as nth from c where length(replace(term, term[1], '')) > 0),
    t as (select l.doc_id, s[1 : r.n] as term, 0 as nth from l join r using (doc_id) union all select doc_id, term, nth from m where nth <= 8),
    f as (select doc_id, term, min(nth) as nth from t group by doc_id, term),
    o as (select doc_id, list(term order by nth)[1:8] as terms from f group by doc_id)
    select d.doc_id, coalesce(array_to_string(terms, ' '), '') as terms from documents d left join o using (doc_id) where length(regexp_replace(lower(coalesce(d.text, '')), '[^a-z]', '', 'g')) > 1
""")
def mined_terms(spark: SparkSession, d: str) -> DataFrame:
    """Repeated unit and commonest grams of the letters of every document that has some."""
    docs = spread(read(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))).where(F.length(F.regexp_replace("text", "[^a-z]", "")) > 1)
    return docs.select("doc_id", F.array_join(M.mined_terms(F.col("text"), "a-z"), " ").alias("terms"))


@query("""
    with p as (select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as page from conversations)
    select conv_id, turn, cast(page as int) as first_page, cast(page as int) as last_page from p where length(trim(text)) > 0
""")
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every turn of a conversation looked for in the conversation's text, one page a turn, by its number and words."""
    turns = read(spark, d, "conversations").where(F.length(F.trim("text")) > 0).select("conv_id", "turn", F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit(" of "), F.col("conv_id").cast("string"), F.lit(": "), "text").alias("t"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("x"))  # a conversation is one document
    raw = F.array_join(F.transform("x", lambda e, i: F.concat(F.lit("<!-- PAGE_START: "), (i + 1).cast("string"), F.lit(" -->"), e["t"], F.lit("\n"))), "")
    paged = G.with_pages(listed.withColumn("raw", raw).withColumn("chunks", F.col("x.t")), "raw", "chunks")
    return paged.select("conv_id", F.explode(F.arrays_zip(F.col("x.turn").alias("turn"), "pages")).alias("p")).select("conv_id", "p.turn", F.col("p.pages.first").alias("first_page"), F.col("p.pages.last").alias("last_page"))


_LOG = "select user_id % 50 as doc, event_id % 4 as subject, ts, event_id, case when event_type = 'purchase' then 'GRANT' else 'REVOKE' end as action from events where event_type in ('purchase', 'error')"


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("event_type in ('purchase', 'error')")
    return e.select((F.col("user_id") % 50).alias("doc"), (F.col("event_id") % 4).alias("subject"), "ts", "event_id", F.when(F.col("event_type") == "purchase", "GRANT").otherwise("REVOKE").alias("action"))


@query(f"""
    with l as ({_LOG}), p as (select event_id, user_id % 50 as doc, event_id % 4 as subject, ts from events where event_type = 'view'),
    s as (select p.event_id, max_by(l.action, (l.ts, l.event_id)) as action from p left join l on l.doc = p.doc and l.subject = p.subject and l.ts <= p.ts group by p.event_id)
    select event_id, action, coalesce(action = 'GRANT', false) as readable from s
""")
def readable_at_time(spark: SparkSession, d: str) -> DataFrame:
    """Whether a view was allowed when it happened, by the log of grants and revocations up to then."""
    views = read(spark, d, "events").where("event_type = 'view'").select("event_id", (F.col("user_id") % 50).alias("doc"), (F.col("event_id") % 4).alias("subject"), "ts")
    found = H.state_at(views.withColumnRenamed("event_id", "view_id"), _log(spark, d), ["doc", "subject"], "ts", "action", "event_id")
    return found.select(F.col("view_id").alias("event_id"), "action", F.coalesce(F.col("action") == "GRANT", F.lit(False)).alias("readable"))


@query(f"""
    with l as ({_LOG}), n as (select *, lead(ts) over (partition by doc, subject order by ts, event_id) as valid_to from l)
    select doc, subject, action, ts as valid_from, valid_to from n where valid_to is null or valid_to > ts
""")
def permission_spans(spark: SparkSession, d: str) -> DataFrame:
    return H.spans(_log(spark, d), ["doc", "subject"], "ts", "action", "event_id")


@query("""
    select o_orderkey as id, greatest(o_custkey % 3, o_custkey % 4) as version, case when o_custkey % 4 > o_custkey % 3 then o_orderpriority else o_orderstatus end as payload from orders
""")
def versioned_reindex(spark: SparkSession, d: str) -> DataFrame:
    """Two jobs write the same keys, the second twice: each batch once, and a row only over a lower version."""
    path = _fresh(spark, "ledger")
    orders = read(spark, d, "orders")
    rows = lambda v, payload: orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % v).alias("version"), F.col(payload).alias("payload"))
    for job, v, payload in (("first", 3, "o_orderstatus"), ("second", 4, "o_orderpriority"), ("second", 4, "o_orderpriority")):
        ledger.write_batches(rows(v, payload), path, job, "id", "version", batches=2)
    return ledger.latest(ledger.read_ledger(spark, path, rows(3, "o_orderstatus").schema), "id", "version")


@query("select event_id, ts from events")
def incremental_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table that grows between two runs of one stream, with rows added at the very time where the first run ended."""
    path, run = _fresh(spark, "growing"), _fresh(spark, "growing-run")
    e = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    cut = Q.select_positions(e.select(F.unix_micros("ts").alias("t")), [], "t", {"mid": F.floor(F.col("n") / 2)}).first()
    at, out = F.unix_micros("ts"), e.limit(0)
    early = (at < F.lit(cut["mid"])) | ((at == F.lit(cut["mid"])) & (F.col("event_id") % 2 == 0)) if cut else F.lit(True)
    for part in (e.where(early), e.where(~early)):
        part.write.mode("append").parquet(path)
        out = _drained(spark, increments.new_rows(spark, path, e.schema, "event_id", "ts"), "append", run)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""
    with s as (select 'c' || c_custkey as source, case when c_custkey % 5 = 0 then ['_NO_ACCESS'] else ['u' || c_nationkey, c_mktsegment] end as tokens, cast(c_nationkey as varchar) as unit, c_custkey % 100 as v from customer where c_custkey % 3 = 0)
    select o_orderkey, s.source is not null as updated, array_to_string(case when s.source is null then ['old'] else tokens end, ',') as acl_tokens, case when s.source is null then 'global' else unit end as owner_unit_code, case when s.source is null then 0 else v end as permission_version
    from orders left join s on s.source = 'c' || o_custkey
""")
def snapshot_applied(spark: SparkSession, d: str) -> DataFrame:
    """Rights of a third of the customers, exported as JSON lines and applied to all orders by their source."""
    path = _fresh(spark, "snapshot")
    c = read(spark, d, "customer").where("c_custkey % 3 = 0")
    tokens = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.to_json(F.array(F.concat(F.lit("u"), F.col("c_nationkey").cast("string")), "c_mktsegment")))
    c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("source_name"), tokens.alias("acl_tokens"), F.col("c_nationkey").cast("string").alias("dept_code"), (F.col("c_custkey") % 100).alias("permission_version")).write.json(path)
    rows = read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source"), F.array(F.lit("old")).alias("acl_tokens"), F.lit("global").alias("owner_unit_code"), F.array(F.lit("global")).alias("visible_unit_codes"), F.lit(0).cast("long").alias("permission_version"))
    records = B.snapshot_records(B.read_snapshot(spark, path), F.lit(-1).cast("long"))
    out = B.apply_snapshot(rows, records, "source")
    return out.select("o_orderkey", "updated", F.array_join("acl_tokens", ",").alias("acl_tokens"), "owner_unit_code", "permission_version")


@query("""
    select conv_id, turn, coalesce(text, '') as content, case when turn % 2 = 0 then role else '_NO_ACCESS' end as acl_tokens, case when turn % 3 = 0 then 'kb_' || role else 'kb_target' end as source_index,
      case when turn % 3 = 0 then 'kb_' || role else 'kb_target' end as index_code, case when turn % 2 = 0 then role else 'global' end as owner_unit_code, case when turn % 2 = 0 then turn else -1 end as permission_version from conversations
""")
def second_form_rows(spark: SparkSession, d: str) -> DataFrame:
    """Turns brought to the second form of a chunk row: own values first, then the metadata's, then defaults."""
    c = read(spark, d, "conversations")
    none, even = F.lit(None).cast("string"), F.col("turn") % 2 == 0
    meta = F.struct(F.when(even, F.col("role")).alias("acl_tokens"), none.alias("visible_unit_codes"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("kb_"), "role")).alias("source_index"), none.alias("index_code"), F.when(even, F.col("role")).alias("owner_unit_code"), F.when(even, F.col("turn").cast("string")).otherwise("x").alias("permission_version"))
    own = [F.lit(" ").alias(f) for f in ("acl_tokens", "source_index", "index_code", "owner_unit_code")] + [none.alias(f) for f in ("display_content", "chunk_granularity", "parent_chunk_id", "keywords", "visible_unit_codes", "permission_version")]
    out = B.second_form(c.select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("content"), *own, meta.alias("meta")), "kb_target", F.lit(-1).cast("long"))
    return out.select("id.conv_id", "id.turn", "content", F.array_join("acl_tokens", ",").alias("acl_tokens"), "source_index", "index_code", "owner_unit_code", "permission_version")
