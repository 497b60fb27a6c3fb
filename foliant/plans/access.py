"""Access control over the star schema: customers are users, nations and regions departments, orders documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import access as A
from foliant.sources.tables import read_table as read

from .registry import query

#: The user of the examples: nation 3 of its region.
WHO = A.Identity(user="7", departments=("n3",), roles=("editor",))

_DOCS = """
    with g as (select o_orderkey, o_custkey, n.n_nationkey as nk, n.n_regionkey as rk, ['PUBLIC', 'INTERNAL', 'DEPT', 'PRIVATE', 'GRANT', null][1 + o_orderkey % 6] as visibility,
      case when o_orderkey % 11 = 0 then 'DELETED' else 'INDEXED' end as status
      from orders join customer on o_custkey = c_custkey join nation n on c_nationkey = n.n_nationkey)"""
_TOK = """case visibility when 'PUBLIC' then ['public'] when 'INTERNAL' then ['internal'] when 'DEPT' then ['dept::r' || rk, 'dept::n' || nk]
      when 'GRANT' then list_filter(['user::' || o_custkey, 'user::' || (o_custkey % 10), 'role::editor'], lambda x: true) else ['user::' || o_custkey] end"""


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents with visibility, department chain and owner."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    k = F.col("o_orderkey")
    vis = F.element_at(F.array(*[F.lit(v) for v in ("PUBLIC", "INTERNAL", "DEPT", "PRIVATE", "GRANT", None)]), (k % 6 + 1).cast("int"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # the 25 nations
    chain = F.array(F.concat(F.lit("r"), F.col("n_regionkey")), F.concat(F.lit("n"), F.col("n_nationkey")))
    return j.select("o_orderkey", F.col("o_custkey").cast("string").alias("owner"), chain.alias("chain"), vis.alias("visibility"), F.when(k % 11 == 0, "DELETED").otherwise("INDEXED").alias("status"))


def _tokens() -> F.Column:
    user = F.array((F.col("owner").cast("long") % 10).cast("string"))
    return A.acl_tokens(F.col("visibility"), F.col("chain"), F.col("owner"), user, F.array(F.lit("editor")))


@query(f"{_DOCS} select o_orderkey, list_sort(list_distinct({_TOK})) as tokens from g")
def acl_token_projection(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("o_orderkey", F.array_sort(F.array_distinct(_tokens())).alias("tokens"))


@query(f"""
    {_DOCS}, t as (select *, {_TOK} as tokens from g)
    select visibility, count(*) as readable from t
    where list_has_any(tokens, ['public', 'internal', 'user::7', 'dept::n3', 'role::editor']) and (coalesce(visibility, '') <> 'DEPT' or list_has_any(['r' || rk, 'n' || nk], ['n3'])) group by visibility
""")
def acl_read_filter(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d).withColumn("tokens", _tokens())
    ok = A.readable(WHO, F.col("tokens"), F.col("visibility"), F.col("chain"), F.col("owner"))
    return t.where(ok).groupBy("visibility").agg(F.count(F.lit(1)).alias("readable"))


@query("""
    with recursive tree as (select 'n' || n_nationkey as code, 'r' || n_regionkey as parent from nation union all select 'r' || r_regionkey, 'root' from region union all select 'root', null),
    up(code, ancestor, depth) as (select code, code, 0 from tree union all select up.code, t.parent, depth + 1 from up join tree t on up.ancestor = t.code where t.parent is not null)
    select code, ancestor, cast(depth as int) as depth from up
""")
def department_ancestors(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("code"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    r = read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("code"), F.lit("root").alias("parent"))
    root = spark.createDataFrame([("root", None)], "code string, parent string")
    return A.ancestors(n.unionByName(r).unionByName(root))


_ACL = "select l_orderkey as source_name, case when l_linenumber > 2 or l_suppkey % 7 <> 1 then 'ABSTAIN' when l_returnflag = 'R' then 'DENY' when l_returnflag = 'A' then 'ALLOW' else 'ABSTAIN' end as effect from lineitem"


@query(f"select source_name, case when bool_or(effect = 'DENY') then 'DENY' when bool_or(effect = 'ALLOW') then 'ALLOW' else 'ABSTAIN' end as decision from ({_ACL}) group by source_name")
def acl_decision_fold(spark: SparkSession, d: str) -> DataFrame:
    return A.fold_decisions(_effects(spark, d), ["source_name"])


def _effects(spark: SparkSession, d: str) -> DataFrame:
    e = F.when(F.expr("l_linenumber > 2 or l_suppkey % 7 <> 1"), "ABSTAIN").when(F.col("l_returnflag") == "R", "DENY").when(F.col("l_returnflag") == "A", "ALLOW").otherwise("ABSTAIN")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_name"), e.alias("effect"))


@query(f"""
    {_DOCS}, dec as (select source_name, case when bool_or(effect = 'DENY') then 'DENY' when bool_or(effect = 'ALLOW') then 'ALLOW' else 'ABSTAIN' end as decision from ({_ACL}) group by source_name),
    gr as (select distinct s from (select l_orderkey as s, case when l_suppkey % 10 = 7 then '7' else '8' end as grantee_id from lineitem) where grantee_id = '7')
    select reason, count(*) as n from (
      select case when status = 'DELETED' then 'deny:deleted' when decision = 'DENY' then 'deny:acl' when decision = 'ALLOW' then 'allow:acl' when coalesce(visibility, 'PRIVATE') = 'PUBLIC' then 'allow:public'
        when visibility = 'INTERNAL' then 'allow:internal' when visibility = 'DEPT' and nk = 3 then 'allow:dept' when o_custkey = 7 then 'allow:owner' when visibility = 'GRANT' and s is not null then 'allow:grant'
        else 'deny:' || lower(coalesce(visibility, 'PRIVATE')) end as reason
      from g left join dec on o_orderkey = source_name left join gr on o_orderkey = s) group by reason
""")
def access_decisions(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).withColumnRenamed("o_orderkey", "source_name")
    grants = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_name"), F.expr("case when l_suppkey % 10 = 7 then '7' else '8' end").alias("grantee_id"))
    out = A.decide(docs, A.fold_decisions(_effects(spark, d), ["source_name"]), grants, WHO)
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_ACL_WHOLE = "select l_orderkey as source_name, case when l_returnflag = 'R' and l_discount >= 0.09 then 'DENY' when l_returnflag = 'A' and l_tax >= 0.07 then 'ALLOW' else 'ABSTAIN' end as effect from lineitem"
_FOLD_WHOLE = f"select source_name, case when bool_or(effect = 'DENY') then 'DENY' when bool_or(effect = 'ALLOW') then 'ALLOW' else 'ABSTAIN' end as decision from ({_ACL_WHOLE}) group by source_name"


def _effects_whole(spark: SparkSession, d: str) -> DataFrame:
    deny, allow = (F.col("l_returnflag") == "R") & F.expr("l_discount >= 0.09"), (F.col("l_returnflag") == "A") & F.expr("l_tax >= 0.07")
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_name"), F.when(deny, "DENY").when(allow, "ALLOW").otherwise("ABSTAIN").alias("effect"))


@query(_FOLD_WHOLE)
def acl_decision_fold_whole(spark: SparkSession, d: str) -> DataFrame:
    """``acl_decision_fold`` with an effect from every row."""
    return A.fold_decisions(_effects_whole(spark, d), ["source_name"])


@query(f"""
    {_DOCS}, dec as ({_FOLD_WHOLE}),
    gr as (select distinct s from (select l_orderkey as s, case when l_quantity >= 45 then '7' else '8' end as grantee_id from lineitem) where grantee_id = '7')
    select reason, count(*) as n from (
      select case when status = 'DELETED' then 'deny:deleted' when decision = 'DENY' then 'deny:acl' when decision = 'ALLOW' then 'allow:acl' when coalesce(visibility, 'PRIVATE') = 'PUBLIC' then 'allow:public'
        when visibility = 'INTERNAL' then 'allow:internal' when visibility = 'DEPT' and nk = 3 then 'allow:dept' when o_custkey = 7 then 'allow:owner' when visibility = 'GRANT' and s is not null then 'allow:grant'
        else 'deny:' || lower(coalesce(visibility, 'PRIVATE')) end as reason
      from g left join dec on o_orderkey = source_name left join gr on o_orderkey = s) group by reason
""")
def access_decisions_whole(spark: SparkSession, d: str) -> DataFrame:
    """``access_decisions`` with an effect and a grant from every row."""
    docs = documents(spark, d).withColumnRenamed("o_orderkey", "source_name")
    grants = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_name"), F.expr("case when l_quantity >= 45 then '7' else '8' end").alias("grantee_id"))
    out = A.decide(docs, A.fold_decisions(_effects_whole(spark, d), ["source_name"]), grants, WHO)
    return out.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""
    select event_type, count(*) as n from events where value is not null and user_id % 2 = 1 and (ts is null or ts > timestamp '2024-01-10 00:00:00') group by event_type
""")
def active_grants(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where("value is not null").withColumn("is_active", F.col("user_id") % 2)
    return A.active(e, F.lit("2024-01-10 00:00:00").cast("timestamp"), "ts").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
    {_DOCS}, t as (select o_orderkey, list_distinct({_TOK}) as tokens from g),
    a as (select o_orderkey, list_sort(list_distinct(list_concat(tokens, ['user::99']))) as granted, list_sort(list_filter(tokens, lambda x: x <> 'public')) as r from t)
    select o_orderkey, granted, case when len(r) = 0 then ['_NO_ACCESS'] else r end as revoked from a
""")
def grant_and_revoke(spark: SparkSession, d: str) -> DataFrame:
    t = documents(spark, d).select("o_orderkey", F.array_distinct(_tokens()).alias("tokens"))
    return t.select("o_orderkey", F.array_sort(A.grant(F.col("tokens"), F.lit("user::99"))).alias("granted"), F.array_sort(A.revoke(F.col("tokens"), F.lit("public"))).alias("revoked"))


@query("select doc_id, coalesce(case when doc_id % 3 = 0 then true when doc_id % 3 = 1 then false end, true) as is_latest from documents where coalesce(case when doc_id % 3 = 0 then true when doc_id % 3 = 1 then false end, true)")
def latest_or_missing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    flag = F.when(k == 0, True).when(k == 1, False)
    return read(spark, d, "documents").select("doc_id", A.latest(flag).alias("is_latest")).where("is_latest")
