"""Context of hits, synonyms, merged candidates, evidence, claims, screened rows and readable indices over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import context as X
from foliant.operators import policy as P
from foliant.sources.tables import read_table as read

from .registry import query


@query("""
    with h as (select distinct l_orderkey, l_linenumber as at from lineitem where l_quantity >= 49)
    select l.l_orderkey, l.l_linenumber, case when bool_or(h.at = l.l_linenumber) then 'hit' else 'neighbor' end as source_type
    from (select *, row_number() over () as r from lineitem) l join h on l.l_orderkey = h.l_orderkey and l.l_linenumber between h.at - 1 and h.at + 2 group by l.r, l.l_orderkey, l.l_linenumber
""")
def evidence_window(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return X.neighbours(items.where("l_quantity >= 49"), items.drop("l_quantity"), "l_orderkey", "l_linenumber", 1, 2).select("l_orderkey", "l_linenumber", "source_type")


@query("""
    with c as (select l_suppkey as q, l_orderkey, l_linenumber, l_tax + 0.01e0 as rrf from lineitem where l_quantity >= 49),
    m as (select q, min(rrf) as least, count(distinct l_orderkey) as docs from c group by q),
    s as (select d.q, l.l_orderkey, l.l_linenumber, row_number() over (partition by d.q order by l.l_orderkey, l.l_linenumber) as n from lineitem l join (select distinct q, l_orderkey from c) d using (l_orderkey)
      where not exists (select 1 from c where c.q = d.q and c.l_orderkey = l.l_orderkey and c.l_linenumber = l.l_linenumber))
    select q, l_orderkey, l_linenumber, round(greatest(least * 0.75e0, 0.01e0), 6) as rrf from s join m using (q) where n <= 300 and n <= docs * 10
""")
def sibling_chunks(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "lineitem")
    c = items.where("l_quantity >= 49").select(F.col("l_suppkey").alias("q"), "l_orderkey", "l_linenumber", (F.col("l_tax") + 0.01).alias("rrf"))
    more = X.siblings(c, items.select("l_orderkey", "l_linenumber"), "q", "l_orderkey", ["l_linenumber"])
    return more.select("q", "l_orderkey", "l_linenumber", F.round("rrf", 6).alias("rrf"))


@query("""
    select c.conv_id, c.turn, case when p.turn is null then case when c.turn % 2 = 1 then 'fine' else 'coarse' end else 'coarse' end as granularity, md5(coalesce(p.text, c.text)) as shown
    from conversations c left join conversations p on c.turn % 2 = 1 and p.conv_id = c.conv_id and p.turn = c.turn - 1
""")
def small_to_big(spark: SparkSession, d: str) -> DataFrame:
    """Odd turns stand for fine chunks of the turn before them."""
    name = lambda turn: F.concat_ws("_", "conv_id", turn)
    kind = F.when(F.col("turn") % 2 == 1, "fine").otherwise("coarse")
    c = read(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("content"), name(F.col("turn")).alias("chunk_id"), name(F.col("turn") - 1).alias("parent_chunk_id"), kind.alias("granularity"))
    return X.with_parents(c, c).select("conv_id", "turn", "granularity", F.md5("display_content").alias("shown"))


_SYNONYMS = [(1, "than", "that, stin", "EQUIV", 1), (2, "stin", "inst", "ABBR", 1), (3, "thing", "wh", "EQUIV", 1), (4, "orwhes", "or", "EQUIV", 0), (5, "for", "that,wh", "EQUIV", 1)]


@query("""
    with k(key, terms) as (values ('than', ['than', 'that', 'stin']), ('that', ['than', 'that', 'stin']), ('stin', ['stin', 'inst']), ('thing', ['thing', 'wh']), ('wh', ['thing', 'wh']), ('for', ['for', 'that', 'wh'])),
    m as (select distinct conv_id, turn, unnest(terms) as term from conversations join k on contains(text, key) where role = 'user')
    select conv_id, turn, list_sort(list(term)) as terms from m group by conv_id, turn
""")
def synonym_expansion(spark: SparkSession, d: str) -> DataFrame:
    keys = X.synonym_keys(spark.createDataFrame(_SYNONYMS, "id int, abbr string, full_terms string, kind string, enabled int"))
    return X.expand_synonyms(read(spark, d, "conversations").where("role = 'user'"), keys, ["conv_id", "turn"])


@query(r"""
    with c as (select conv_id, turn, list_filter(list_transform(string_split_regex(text, '[？?,、。！？]+'), lambda c: regexp_replace(c, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), lambda c: length(c) > 6) as clauses from conversations)
    select conv_id, turn, clauses from c where len(clauses) >= 2
""")
def question_clauses(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn", X.clauses(F.col("text")).alias("clauses"))
    return c.where(F.size("clauses") >= 2)


_MARKED = "regexp_replace({}, '({})', '<em class=''highlight''>\\1</em>', 'gi')"


@query(f"select doc_id, md5({_MARKED.format(_MARKED.format('text', 'that'), 'the')}) as marked from documents")
def highlighted_terms(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.md5(X.highlight(F.col("text"), "the that a", None)).alias("marked"))


def _field(f: str) -> str:
    one = "case when {t} > 0 then ln(1 + (n_{f} - d{i}_{f} + 0.5e0) / (d{i}_{f} + 0.5e0)) * {t} * 2.2e0 / ({t} + 1.2e0 * (0.25e0 + 0.75e0 * l_{f} / a_{f})) else 0 end"
    return "(" + " + ".join(one.format(t=f"t{i}_{f}", f=f, i=i) for i in (0, 1)) + ")"


def _counts(f: str) -> str:
    hit = lambda w: f"len(list_filter(w_{f}, lambda x: x = '{w}'))"
    return f"len(w_{f}) as l_{f}, {hit('the')} as t0_{f}, {hit('that')} as t1_{f}"


def _stats(f: str) -> str:
    return f"count(l_{f}) as n_{f}, avg(l_{f}) as a_{f}, count(*) filter (t0_{f} > 0) as d0_{f}, count(*) filter (t1_{f} > 0) as d1_{f}"


@query(f"""
    with w as (select doc_id, source, list_filter(string_split_regex(lower(string_split(text, chr(10))[1]), '[^a-z0-9]+'), lambda t: t <> '') as w_title, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '') as w_terms from documents),
    c as (select doc_id, source, {_counts('title')}, {_counts('terms')} from w), s as (select {_stats('title')}, {_stats('terms')} from c),
    r as (select doc_id, coalesce(10 * {_field('title')}, 0) + coalesce(4 * {_field('terms')}, 0) + case when source = 'the that' then 18 else 0 end as score from c, s)
    select doc_id, round(score, 6) as score from r where score > 0
""")
def document_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Documents by title and terms with the boosts of the document recall; gram and phrase fields are not part of it."""
    docs = read(spark, d, "documents").select("doc_id", "source", F.split("text", "\n")[0].alias("title"), F.col("text").alias("terms"))
    return X.fielded_bm25(docs, "the that", {"title": 10.0, "terms": 4.0}, {"source": 18.0}).select("doc_id", F.round("score", 6).alias("score"))


@query("""
    with c as (select case when c_custkey % 3 = 0 then 'source:' || c_name else 'id:' || c_custkey end as key, (['', 'knn', 'knn,doc_search', 'keyword'])[c_custkey % 4 + 1] as recall from customer),
    n as (select distinct 'id:' || o_custkey as key from orders)
    select coalesce(c.key, n.key) as key, case when n.key is null then recall when coalesce(recall, '') = '' then 'doc_search' when recall like '%doc_search' then recall else recall || ',doc_search' end as recall from c full join n on c.key = n.key
""")
def merged_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    tags = F.element_at(F.array(*map(F.lit, ("", "knn", "knn,doc_search", "keyword"))), (k % 4 + 1).cast("int"))
    c = read(spark, d, "customer").select(F.when(k % 3 == 0, "").otherwise(k.cast("string")).alias("doc_id"), F.col("c_name").alias("source"), tags.alias("recall"))
    found = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doc_id"), F.lit("").alias("source"))
    return X.merge_candidates(c, found, "doc_search")


@query("""
    with l as (select l_partkey as q, l_suppkey as file, l_orderkey, l_linenumber, l_returnflag || l_linestatus || l_linenumber as text, l_quantity, l_tax, l_discount from lineitem),
    k as (select *, dense_rank() over (partition by q order by file) as doc_rank from l),
    a as (select *, row_number() over (partition by q, file, text order by l_orderkey, l_linenumber, text) as same from k where doc_rank <= 5),
    b as (select *, row_number() over (partition by q, file order by l_orderkey, l_linenumber, text) as nth from a where same = 1),
    e as (select q, file, 'doc_chunk' as kind, text, 0 as k, doc_rank as r, l_orderkey, l_linenumber from b where nth <= 2),
    f as (select * from (select *, row_number() over w as n, coalesce(sum(length(text)) over (w rows between unbounded preceding and 1 preceding), 0) as used from e window w as (partition by q order by r, l_orderkey, l_linenumber, text)) where n <= 8 and used < 20),
    p as (select q, file, 'qa_pair' as kind, text, 1 as k, 0 as r, l_orderkey, l_linenumber, row_number() over (partition by q, file order by l_orderkey, l_linenumber, text) as nth from l where l_tax < 0.05 and not exists (select 1 from f where f.q = l.q and f.file = l.file)),
    u as (select q, file, kind, text, k, r, l_orderkey, l_linenumber from f union all select q, file, kind, text, k, r, l_orderkey, l_linenumber from p where nth = 1)
    select q, n, file, kind, text from (select *, row_number() over w as n, coalesce(sum(length(text)) over (w rows between unbounded preceding and 1 preceding), 0) as used from u window w as (partition by q order by k, r, l_orderkey, l_linenumber, text)) where n <= 8 and used < 20
""")
def prompt_evidence(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    rows = read(spark, d, "lineitem").select(F.col("l_partkey").alias("q"), F.col("l_suppkey").alias("file"), F.struct("l_orderkey", "l_linenumber", text.alias("t")).alias("place"), text.alias("text"), (F.col("l_tax") < 0.05).alias("is_latest"))
    docs = rows.withColumn("doc_rank", F.dense_rank().over(Window.partitionBy("q").orderBy("file")))
    return X.assemble_evidence(docs.drop("is_latest"), rows, "q", max_docs=5, per_doc=2, total=8, max_chars=20)


@query("""
    with c as (select o_custkey as plan, o_orderkey as claim, case when o_orderstatus = 'P' then [] else [o_orderkey, o_orderkey + 1] end as facts, case when o_orderpriority = '1-URGENT' then [] else [o_orderkey % 5, 7] end as citations from orders),
    f as (select o_custkey as plan, o_orderkey as fact, o_orderkey % 5 as citation from orders),
    e as (select plan, claim, 'claim_missing_fact' as error, null as what from c where len(facts) = 0 union all select plan, claim, 'claim_missing_citation', null from c where len(citations) = 0
      union all select plan, claim, 'claim_unknown_fact', cast(x as varchar) from (select plan, claim, unnest(facts) as x from c) a where not exists (select 1 from f where f.plan = a.plan and f.fact = x)
      union all select plan, claim, 'claim_unknown_citation', cast(x as varchar) from (select plan, claim, unnest(citations) as x from c) a where not exists (select 1 from f where f.plan = a.plan and f.citation > 0 and f.citation = x))
    select plan, claim, error, what from e
""")
def claim_validation(spark: SparkSession, d: str) -> DataFrame:
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    none = F.array().cast("array<bigint>")
    named = F.when(F.col("o_orderstatus") == "P", none).otherwise(F.array(k, k + 1))
    cited = F.when(F.col("o_orderpriority") == "1-URGENT", none).otherwise(F.array(k % 5, F.lit(7).cast("long")))
    plan = F.col("o_custkey").alias("plan")
    return X.claim_errors(o.select(plan, k.alias("claim"), named.alias("facts"), cited.alias("citations")), o.select(plan, k.alias("fact"), (k % 5).alias("citation")), "plan")


@query("with h as (select doc_id, md5(text) as h, doc_id % 5 as v from documents) select doc_id, h, v from h where v = (select max(v) from h g where g.h = h.h)")
def newest_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select("doc_id", F.md5("text").alias("h"), (F.col("doc_id") % 5).alias("v"))
    return X.newest_of_hash(rows, "h", "v").select("doc_id", "h", "v")


@query("""
    with r as (select l_partkey, l_linestatus || l_linenumber as subject, case when l_discount >= 0.08 then 'DENY' else 'ALLOW' end as effect from lineitem where l_discount >= 0.05),
    h as (select l_partkey, bool_or(subject in ('O1', 'O2') and effect = 'DENY') as deny, bool_or(subject in ('O1', 'O2') and effect = 'ALLOW') as allow from r group by l_partkey)
    select p_partkey from part left join h on l_partkey = p_partkey where deny is null or (not deny and allow)
""")
def readable_scope(spark: SparkSession, d: str) -> DataFrame:
    effect = F.when(F.col("l_discount") >= 0.08, "DENY").otherwise("ALLOW")
    rules = read(spark, d, "lineitem").where("l_discount >= 0.05").select(F.col("l_partkey").alias("p_partkey"), F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("subject"), effect.alias("effect"))
    return X.readable_indices(read(spark, d, "part").select("p_partkey"), rules, "p_partkey", ["O1", "O2"])


_RULES = [P.Policy(1, "WORD", "that", "MASK", "***", priority=1), P.Policy(2, "WORD", "idiot", "BLOCK_QA", priority=5), P.Policy(3, "WORD", "the", "MASK", "", priority=3)]


def _screened(spark: SparkSession, d: str) -> DataFrame:
    return P.screen_rows(read(spark, d, "documents").select("doc_id", "text", "source"), ["text", "source"], _RULES)


@query("""
    with m as (select doc_id, text, source, replace(replace(text, 'the', '[REDACTED]'), 'that', '***') as t, replace(replace(source, 'the', '[REDACTED]'), 'that', '***') as s from documents)
    select doc_id, md5(t) as text_md5, s as source, coalesce(t <> text, false) or coalesce(s <> source, false) as sensitive_filtered from m
    where not coalesce(contains(text, 'idiot'), false) and not coalesce(contains(source, 'idiot'), false)
""")
def screened_rows(spark: SparkSession, d: str) -> DataFrame:
    return _screened(spark, d).where("not blocked").select("doc_id", F.md5("text").alias("text_md5"), "source", "sensitive_filtered")


@query("""
    with f as (select doc_id, 'text' as field, text as x from documents union all select doc_id, 'source', source from documents where not coalesce(contains(text, 'idiot'), false)),
    p(policy, word, nth) as (values (2, 'idiot', 1), (3, 'the', 2), (1, 'that', 3)),
    c as (select doc_id, field, case when policy = 1 then replace(x, 'the', '[REDACTED]') else x end as y, policy, word, nth, contains(x, 'idiot') as stop from f, p)
    select doc_id, field, policy, least(1000, len(string_split(case word when 'that' then replace(y, 't', 'tt') else y end, word)) - 1) as hits from c where contains(y, word) and (nth = 1 or not stop)
""")
def sensitive_hit_audit(spark: SparkSession, d: str) -> DataFrame:
    """One row a field and policy that was hit, with that policy's own hits."""
    hit = _screened(spark, d).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.field", F.explode("h.each").alias("e"))
    return hit.select("doc_id", "field", "e.policy", "e.hits")
