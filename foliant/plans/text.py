"""Queries of scalar functions, predicates and cleaning over ``documents``, ``pages`` and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import cleaning as C
from foliant.operators import evidence as E
from foliant.sources.tables import read_table as read

from .registry import query

TOK = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"


@query("""
    select doc_id, coalesce(nullif(trim(source), ''), '') as given,
           sha256(substring(text, 1, 2000)) as content_hash, md5(source) || '_v' || cast(doc_id % 3 as varchar) || '_chunk_' || cast(doc_id as varchar) as chunk_id,
           md5(source) as doc_hash
    from documents
""")
def content_hash_and_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    cid = T.chunk_id(F.col("source"), F.col("doc_id") % 3, F.col("doc_id"))
    none = F.lit(None).cast("string")
    return docs.select("doc_id", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("")).alias("given"), T.content_hash(none, none.cast("binary"), F.col("text")).alias("content_hash"), cid.alias("chunk_id"), T.document_of(cid).alias("doc_hash"))


@query("""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as raw from documents),
    c as (select doc_id, trim(regexp_replace(raw, '[ \\t]+', ' ', 'g')) as line from l)
    select doc_id, line, count(*) as n from c where line <> '' and length(line) <= 30 group by doc_id, line having count(*) >= 3
""")
def frequent_short_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.frequent_short_lines(read(spark, d, "documents"))


@query("""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)
    select case when length(line) = 0 then 'empty' when length(line) <= 30 then 'short' when length(line) <= 200 then 'medium' else 'long' end as line_class,
           count(*) as n, count(distinct doc_id) as docs from l group by 1
""")
def line_length_classes(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    n = F.length("line")
    cls = F.when(n == 0, "empty").when(n <= 30, "short").when(n <= 200, "medium").otherwise("long")
    return lines.groupBy(cls.alias("line_class")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


@query()
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_documents(read(spark, d, "documents"))


@query(r"""
    select doc_id, length(regexp_replace(text, '[^A-Za-z0-9一-鿿]', '', 'g')) as effective_chars,
           length(regexp_replace(text, '[^A-Za-z0-9一-鿿]', '', 'g')) >= 10 as keep
    from documents
""")
def effective_chars_gate(spark: SparkSession, d: str) -> DataFrame:
    n = C.effective_chars(F.col("text"))
    return read(spark, d, "documents").select("doc_id", n.cast("long").alias("effective_chars"), (n >= 10).alias("keep"))


@query(f"""
    select doc_id, array_to_string(list_slice(list_distinct_ordered, 1, 8), ' ') as keywords from (
      select doc_id, list_filter(list_transform(generate_series(1, len(w)), lambda i: case when list_position(w, w[i]) = i then w[i] end), lambda x: x is not null) as list_distinct_ordered
      from (select doc_id, regexp_extract_all(lower(text), '[a-z]{{2,}}') as w from documents))
""")
def keyword_top8(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.array_join(T.keywords(F.col("text"), 8), " ").alias("keywords"))


@query("""
    select doc_id, case when p > 0 then (case when b > 1 then '...' else '' end) || substring(text, b, e - b) || (case when e <= length(text) then '...' else '' end)
           else substring(text, 1, 100) end as snippet
    from (select doc_id, text, p, greatest(p - 40, 1) as b, least(p + 4 + 60, length(text) + 1) as e
          from (select doc_id, text, instr(lower(text), 'tion') as p from documents))
""")
def snippet_first_hit(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), F.lit("tion")).alias("snippet"))


@query("""
    select p_partkey, p_type, list_transform(generate_series(1, len(string_split(p_type, ' '))), lambda i: array_to_string(list_slice(string_split(p_type, ' '), 1, i), '-')) as chain
    from part
""")
def department_value_chain(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", "p_type", T.department_values(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("chain"))


@query(r"""
    with c as (select c_custkey, lpad(cast(c_custkey as varchar), 6, '6') || case when c_custkey % 3 = 0 then '0000' when c_custkey % 3 = 1 then '00' else '' end as code from customer)
    select c_custkey, code, regexp_replace(code, '^(.+?)(00)+$', '\1') as normal, left(code, 2) as l2, left(code, 4) as l4, left(code, 6) as l6, left(code, 9) as l9 from c
""")
def department_codes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.concat(F.lpad(k.cast("string"), 6, "6"), F.when(k % 3 == 0, "0000").when(k % 3 == 1, "00").otherwise(""))
    c = read(spark, d, "customer").select("c_custkey", code.alias("code"))
    lv = T.department_levels(F.col("code"))
    return c.select("c_custkey", "code", T.department_code(F.col("code")).alias("normal"), lv["dept_l2"].alias("l2"), lv["dept_l4"].alias("l4"), lv["dept_l6"].alias("l6"), lv["dept_l9"].alias("l9"))


@query(f"""
    with t as (select doc_id, source, {TOK} as toks from documents)
    select doc_id, cast(len(toks) as int) as n_tokens, cast(len(list_distinct(toks)) as int) as n_distinct, list_contains(toks, 'the') and list_contains(toks, 'and') as has_both from t
""")
def analyze_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    both = F.array_contains("t", "the") & F.array_contains("t", "and")
    return read(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), both.alias("has_both"))


def _overlap_sql(n: int) -> str:
    return f"""
        with n as (select conv_id, turn, role, lower(text) as q, lead(role) over (partition by conv_id order by turn) as next_role, lower(lead(text) over (partition by conv_id order by turn)) as a from conversations),
        g as (select conv_id, turn, a, list_distinct(list_transform(generate_series(1, length(q) - {n - 1}), lambda i: substring(q, i, {n}))) as grams from n where role = 'user' and next_role = 'assistant' and length(q) >= {n} and a is not null)
        select conv_id, turn, round(len(list_filter(grams, lambda x: contains(a, x))) / len(grams), 6) as overlap from g
    """


def _overlap(spark: SparkSession, d: str, n: int) -> DataFrame:
    pairs = E.qa_pairs(read(spark, d, "conversations")).where(f"length(question) >= {n} and answer is not null")
    return pairs.select("conv_id", "turn", F.round(T.ngram_overlap(F.col("question"), F.col("answer"), n), 6).alias("overlap"))


@query(_overlap_sql(2))
def bigram_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Character bigrams of every question that its answer holds, whole texts."""
    return _overlap(spark, d, 2)


@query(_overlap_sql(3))
def answer_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Character trigrams of every question that its answer holds, whole texts."""
    return _overlap(spark, d, 3)


@query(r"""
    select page_id, regexp_extract(url, '^(https?)://', 1) as scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) as host,
           nullif(regexp_extract(url, '\?([^#]*)', 1), '') as query_string, regexp_extract(html, '<title>([^<]*)</title>', 1) as title,
           regexp_extract(html, '<html lang="([a-z]+)"', 1) as html_lang
    from pages
""")
def page_fields(spark: SparkSession, d: str) -> DataFrame:
    u, h = F.col("url"), F.col("html")
    return read(spark, d, "pages").select(
        "page_id", F.regexp_extract(u, "^(https?)://", 1).alias("scheme"), F.regexp_extract(u, "^https?://([^/?#]+)", 1).alias("host"),
        F.nullif(F.regexp_extract(u, r"\?([^#]*)", 1), F.lit("")).alias("query_string"), F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("html_lang"),
    )


@query(r"""
    with t as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', chr(10), 'g') as x from pages),
    e as (select page_id, replace(replace(replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as x from t)
    select page_id, md5(array_to_string(list_filter(list_transform(string_split(x, chr(10)), lambda s: regexp_replace(s, '^[\s　]+|[\s　]+$', '', 'g')), lambda s: s <> ''), chr(10))) as text_md5 from e
""")
def html_fallback_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text_md5"))


@query()
def html_structured_text(spark: SparkSession, d: str) -> DataFrame:
    from foliant.sources.parsers import html_markdown

    return read(spark, d, "pages").select("page_id", html_markdown("html").alias("markdown"))


@query("""
    select doc_id, source, case when text ilike '%tion%' then 1 else 0 end as has_kw from documents
    where (text ilike '%tion%' or source ilike '%tion%' or lang ilike '%tion%') and lang in ('en', 'fr', 'de')
""")
def ilike_listing(spark: SparkSession, d: str) -> DataFrame:
    any_ = F.col("text").ilike("%tion%") | F.col("source").ilike("%tion%") | F.col("lang").ilike("%tion%")
    return read(spark, d, "documents").where(any_ & F.col("lang").isin("en", "fr", "de")).select("doc_id", "source", F.when(F.col("text").ilike("%tion%"), 1).otherwise(0).alias("has_kw"))


@query("""
    select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k,
           case when event_type in ('click', 'view') then 'browse' when event_type = 'purchase' then 'buy' else 'other' end as kind
    from events where try_cast(json_extract_string(props, '$.k') as bigint) >= 50
""")
def json_payload_projection(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("long")
    kind = F.when(F.col("event_type").isin("click", "view"), "browse").when(F.col("event_type") == "purchase", "buy").otherwise("other")
    return read(spark, d, "events").select("event_id", k.alias("k"), kind.alias("kind")).where("k >= 50")


@query("""
    select item_id, case when lower(text) like '%which%' or lower(text) like '%list%' then 'LIST' when lower(text) like '%how%' then 'PROCEDURE'
      when lower(text) like '%condition%' or lower(text) like '%require%' then 'CONDITION' when lower(text) like '%when%' then 'COUNT_OR_TIME'
      when lower(text) like '%differ%' or lower(text) like '%compare%' then 'COMPARISON' else 'FACT' end as intent,
      length(text) <= 15 as is_short from benchmark
""")
def question_intent(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select("item_id", T.query_intent(F.col("text")).alias("intent"), (F.length("text") <= 15).alias("is_short"))


@query("""
    select doc_id, n, substring(text, cast(1 + 250 * n as bigint), 300) as piece from (
      select doc_id, text, unnest(generate_series(0, cast(greatest(ceil((length(text) - 300) / 250.0), 0) as bigint))) as n from documents where length(text) > 0)
""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.chunking import sliding_windows as cut

    return cut(read(spark, d, "documents"))


@query(r"""
    with s as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) as x from documents)
    select doc_id, count(*) as sentences, cast(sum(length(trim(x))) as bigint) as chars, max(length(trim(x))) as longest from s where trim(x) <> '' group by doc_id
""")
def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "documents").select("doc_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("x")).where(F.trim("x") != "")
    n = F.length(F.trim("x"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(n).alias("chars"), F.max(n).cast("long").alias("longest"))


@query()
def document_types(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.chunking import document_type

    return read(spark, d, "documents").select("doc_id", document_type(F.col("text")).alias("doc_type"))


@query()
def dual_chunks(spark: SparkSession, d: str) -> DataFrame:
    from foliant.operators.chunking import chunk_documents

    return chunk_documents(read(spark, d, "documents"))


@query()
def pages_normalized(spark: SparkSession, d: str) -> DataFrame:
    from foliant.functions.unicode import normalize_content, normalize_filename, normalize_metadata_text

    return read(spark, d, "pages").select("page_id", normalize_filename("url").alias("file_name"), normalize_metadata_text("url").alias("title"), normalize_content("url").alias("content"))


@query("""
    select doc_id, regexp_extract(substring(text, 1, 1500), '([A-Z][a-z]+)', 1) as first_capital, regexp_extract(substring(text, 1, 1500), '([0-9]+)', 1) as first_number from documents
""")
def dynamic_metadata(spark: SparkSession, d: str) -> DataFrame:
    m = T.dynamic_meta(F.col("text"), {"first_capital": "([A-Z][a-z]+)", "first_number": "([0-9]+)"})
    return read(spark, d, "documents").select("doc_id", m.alias("m")).select("doc_id", F.coalesce(F.col("m.first_capital"), F.lit("")).alias("first_capital"), F.coalesce(F.col("m.first_number"), F.lit("")).alias("first_number"))
